"""Persisted split, cut-points, folds and matrices, each tied to the content fingerprint of its split.

Nothing is overwritten unless asked, and what exists is checked before anything is read. Small tables
are written in one piece, so a half-written artefact is never readable: Spark commits a folder with
its success marker, and the fold cache is only read through a manifest written last.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.operators.cuts import require_all_cuts
from riskloom.operators.signals import upsert
from riskloom.operators.splits import fingerprint, stratified_split

ID = "SK_ID_CURR"
MANIFEST = "manifest"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever filesystem it names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def require_free(spark: SparkSession, paths: Iterable[str], overwrite: bool) -> None:
    """Fail naming what is already there."""
    taken = [] if overwrite else [p for p in paths if exists(spark, p)]
    if taken:
        raise FileExistsError(f"already there: {taken}; pass overwrite=True to replace them")


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


# -- split -------------------------------------------------------------------------------------


def write_split(app: DataFrame, path: str, valid_share: float = 0.2, seed: int | str = 42, overwrite: bool = False) -> DataFrame:
    """Build the split of a cleaned population and write it; returns it read back."""
    spark = app.sparkSession
    require_free(spark, [path], overwrite)
    stratified_split(app, valid_share, seed).write.mode(_mode(overwrite)).parquet(path)
    return read_split(spark, path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """The persisted split; a missing one fails instead of being rebuilt."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no split at {path}; build it once with write_split")
    return spark.read.parquet(path)


# -- cut-points --------------------------------------------------------------------------------


def write_cuts(cuts: Mapping[str, object], split: DataFrame, path: str, n_train: Mapping[str, int] | None = None, overwrite: bool = False) -> None:
    """One row per cut with the fingerprint of its split; nothing is written if any is unset."""
    spark = split.sparkSession
    require_free(spark, [path], overwrite)
    require_all_cuts(cuts)
    mark, n = fingerprint(split), dict(n_train or {})
    rows = [(name, json.dumps(v), n.get(name), mark) for name, v in cuts.items()]
    spark.createDataFrame(rows, "name string, value string, n_train bigint, split_fingerprint string").coalesce(1).write.mode(
        _mode(overwrite)
    ).parquet(path)


def read_cuts(spark: SparkSession, split: DataFrame, path: str) -> dict[str, object]:
    """The cuts, if they were fitted on this very split and none is missing or extra."""
    if not exists(spark, path):
        raise FileNotFoundError(f"no cut-points at {path}")
    rows = spark.read.parquet(path).collect()
    if {r["split_fingerprint"] for r in rows} != {fingerprint(split)}:
        raise ValueError("the cut-points were fitted on another split")
    cuts = {r["name"]: json.loads(r["value"]) for r in rows}
    require_all_cuts(cuts)
    return {k: tuple(v) if isinstance(v, list) else v for k, v in cuts.items()}


# -- folds -------------------------------------------------------------------------------------


def write_folds(parts: Iterable[tuple[int, int, str, DataFrame]], context: DataFrame, mark: str, path: str, overwrite: bool = False) -> None:
    """Matrices of every (seed, k, part) in single precision, the context, and the manifest last."""
    spark = context.sparkSession
    _open_cache(context, path, overwrite)
    done = []
    for seed, k, part, matrix in parts:
        # each fold keeps its own columns, so the partition folders are written one by one
        _single(matrix).write.mode("overwrite").parquet(f"{path}/matrices/seed={seed}/k={k}/part={part}")
        if part == "eval":
            done.append((mark, seed, k, False))
    _close_cache(spark, done, path)


def write_dealt_folds(
    matrix: DataFrame, folds: DataFrame, context: DataFrame, mark: str, path: str, seeds: Iterable[int] = P.SEEDS, overwrite: bool = False, id_col: str = ID
) -> None:
    """The cache of a matrix that no fold refits, from the (id, seed, fold) of its rows; the manifest last.

    Every row is written once, in single precision, beside its fold in each seed: a part of a fold is the rows
    with its number, or all others. A row without a fold in one of the seeds fails.
    """
    spark = context.sparkSession
    seeds = list(seeds)
    _open_cache(context, path, overwrite)
    of = folds.groupBy(id_col).agg(*[F.max(F.when(F.col("seed") == s, F.col("fold"))).alias(_fold_of(s)) for s in seeds])
    lacking = F.raise_error(F.lit("a row of the matrix has no fold")).cast("int")
    rows = _single(matrix).join(of, id_col, "left").withColumns({_fold_of(s): F.coalesce(F.col(_fold_of(s)), lacking) for s in seeds})
    rows.write.mode("overwrite").parquet(f"{path}/dealt")
    pairs = F.array(*[F.struct(F.lit(s).alias("seed"), F.col(_fold_of(s)).alias("k")) for s in seeds])
    dealt = spark.read.parquet(f"{path}/dealt").select(F.explode(pairs).alias("x")).select("x.*").distinct().collect()
    _close_cache(spark, [(mark, r["seed"], r["k"], True) for r in dealt], path)


def _open_cache(context: DataFrame, path: str, overwrite: bool) -> None:
    """Nothing is replaced unasked, an old cache is unreadable from here on, and the context is there."""
    spark = context.sparkSession
    require_free(spark, [f"{path}/{MANIFEST}"], overwrite)
    if overwrite:
        _close_cache(spark, [("stale", -1, -1, False)], path)
    context.write.mode("overwrite").parquet(f"{path}/context")


def _close_cache(spark: SparkSession, rows: list[tuple], path: str) -> None:
    manifest = spark.createDataFrame(rows, "fingerprint string, seed int, k int, dealt boolean")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")


def _single(matrix: DataFrame) -> DataFrame:
    doubles = [c for c, t in matrix.dtypes if t == "double"]
    return matrix.withColumns({c: F.col(f"`{c}`").cast("float") for c in doubles}) if doubles else matrix


def _fold_of(seed: int) -> str:
    return f"_fold_of_seed_{seed}"


def _manifest(spark: SparkSession, path: str, mark: str) -> list[tuple[int, int, bool]]:
    if not exists(spark, f"{path}/{MANIFEST}"):
        raise FileNotFoundError(f"no fold cache at {path}")
    rows = spark.read.parquet(f"{path}/{MANIFEST}").collect()
    if {r["fingerprint"] for r in rows} != {mark}:
        raise ValueError(f"the fold cache at {path} was built from something else")
    return sorted((r["seed"], r["k"], r["dealt"]) for r in rows)


def read_manifest(spark: SparkSession, path: str, mark: str) -> list[tuple[int, int]]:
    """(seed, k) of a cache built for this fingerprint."""
    return [(seed, k) for seed, k, _ in _manifest(spark, path, mark)]


def read_fold(spark: SparkSession, path: str, seed: int, k: int, part: str, dealt: bool = False) -> DataFrame:
    """One part of one fold: its own folder, or its rows of a dealt matrix."""
    if not dealt:
        return spark.read.parquet(f"{path}/matrices/seed={seed}/k={k}/part={part}")
    rows, fold = spark.read.parquet(f"{path}/dealt"), F.col(_fold_of(seed))
    return rows.filter(fold == k if part == "eval" else fold != k).select(*[f"`{c}`" for c in rows.columns if not c.startswith(_fold_of(""))])


def read_folds(spark: SparkSession, path: str, mark: str, seeds: Iterable[int] = P.SEEDS):
    """Folds of a checked cache, lazily: (seed, k, fitting part, evaluation part)."""
    wanted = set(seeds)
    for seed, k, dealt in _manifest(spark, path, mark):
        if seed in wanted:
            yield seed, k, read_fold(spark, path, seed, k, "fit", dealt), read_fold(spark, path, seed, k, "eval", dealt)


def read_context(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """Target, raw amount and presence of every training client."""
    read_manifest(spark, path, mark)
    return spark.read.parquet(f"{path}/context")


# -- matrices and results ----------------------------------------------------------------------

MATRICES = ("X_train", "y_train", "X_valid", "y_valid")


def write_matrices(train: DataFrame, valid: DataFrame, register: DataFrame, folder: str, target: str = "TARGET", overwrite: bool = False) -> dict[str, str]:
    """Feature matrices and targets keyed by client, and the selection register as CSV."""
    paths = {n: f"{folder}/{n}.parquet" for n in MATRICES} | {"register": f"{folder}/seleccion.csv"}
    require_free(train.sparkSession, paths.values(), overwrite)
    for part, df in (("train", train), ("valid", valid)):
        df.drop(target).write.mode(_mode(overwrite)).parquet(paths[f"X_{part}"])
        df.select(ID, target).write.mode(_mode(overwrite)).parquet(paths[f"y_{part}"])
    register.coalesce(1).write.mode(_mode(overwrite)).option("header", True).csv(paths["register"])
    return paths


def accumulate(new: DataFrame, path: str, keys: Iterable[str]) -> DataFrame:
    """Upsert result rows into a CSV table by cell key; returns the whole table.

    A version is written to its own folder and the newest one is the table, so the old rows stay
    readable while the new version is being written and a failed write changes nothing.
    """
    spark = new.sparkSession
    version = 0
    while exists(spark, f"{path}/v={version}/_SUCCESS"):
        version += 1
    rows = new
    if version:
        rows = upsert(spark.read.schema(new.schema).option("header", True).csv(f"{path}/v={version - 1}"), new, keys)
    target = f"{path}/v={version}"
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(target)
    return spark.read.schema(new.schema).option("header", True).csv(target)
