"""Stratified split, folds, undersampling and bootstrap, all from hash ranks.

The order of a row is the hash of its id and the seed, so a partition does not depend on how the data
is laid out and any engine can rebuild it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.operators import bootstrap as B
from riskloom.operators.joins import require_unique
from riskloom.operators.ranks import hash_rank

CLIENT, TARGET, PART = "SK_ID_CURR", "TARGET", "split"
PARTS = ("train", "valid")


def allocate(class_sizes: Mapping, total: int) -> dict:
    """Share ``total`` among classes in proportion to their size, by largest remainder."""
    everything = sum(class_sizes.values())
    exact = {c: n * total / everything for c, n in class_sizes.items()}
    out = {c: math.floor(v) for c, v in exact.items()}
    by_remainder = sorted(exact, key=lambda c: (out[c] - exact[c], c))
    for c in by_remainder[: total - sum(out.values())]:
        out[c] += 1
    return out


def class_sizes(df: DataFrame, target: str = TARGET) -> dict:
    """Rows per class."""
    return {r[target]: r["n"] for r in df.groupBy(target).agg(F.count(F.lit(1)).alias("n")).collect()}


def per_class(target: str, values: Mapping) -> Column:
    """The value of the row's class."""
    return F.coalesce(*[F.when(F.col(target) == c, F.lit(v)) for c, v in values.items()])


def stratified_split(
    df: DataFrame, valid_share: float = 0.2, seed: int | str = 42, id_col: str = CLIENT, target: str = TARGET, check: bool = True
) -> DataFrame:
    """(id, target, split): exact stratified split; repeated ids fail."""
    lacking = [c for c in (id_col, target) if c not in df.columns]
    if lacking:
        raise ValueError(f"split: missing columns {lacking}")
    ids = df.select(id_col, target)
    if check:
        require_unique(ids, id_col, "split")
    sizes = class_sizes(ids, target)
    quota = allocate(sizes, math.ceil(sum(sizes.values()) * valid_share))
    ranked = hash_rank(ids, id_col, seed, [target])
    in_valid = F.col("hash_rank") <= per_class(target, quota)
    return ranked.select(id_col, target, F.when(in_valid, "valid").otherwise("train").alias(PART))


def only(df: DataFrame, part: str, split: DataFrame, id_col: str = CLIENT) -> DataFrame:
    """Rows of one part of the split; an unknown part fails before any read."""
    if part not in PARTS:
        raise ValueError(f"unknown part {part!r}, expected one of {PARTS}")
    if PART not in split.columns:
        raise ValueError(f"the split has no column {PART!r}")
    if id_col not in df.columns:
        raise ValueError(f"{id_col} is not in the frame to filter")
    return df.join(split.filter(F.col(PART) == part).select(id_col), id_col, "left_semi")


def split_summary(split: DataFrame, target: str = TARGET) -> DataFrame:
    """Clients, positives and rate (percent) of the whole and of each part, in one pass."""
    g = split.rollup(PART).agg(
        F.grouping(PART).alias("_g"), F.count(F.lit(1)).alias("clients"), F.sum(target).alias("positives")
    )
    return g.select(
        F.when(F.col("_g") == 1, "conjunto").otherwise(F.col(PART)).alias("part"),
        "clients",
        "positives",
        (F.col("positives") / F.col("clients") * 100).alias("rate_pct"),
    )


def stratified_folds(
    df: DataFrame, seeds: Iterable[int] = P.SEEDS, k: int = P.N_FOLDS, id_col: str = CLIENT, target: str = TARGET
) -> DataFrame:
    """(id, target, seed, fold): each class dealt round the folds in hash order, one set per seed."""
    seeded = df.select(id_col, target, F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed"))
    ranked = hash_rank(seeded, id_col, F.col("seed"), ["seed", target])
    return ranked.select(id_col, target, "seed", F.pmod(F.col("hash_rank") - 1, F.lit(k)).cast("int").alias("fold"))


def undersample(df: DataFrame, seed: int | str = 0, id_col: str = CLIENT, target: str = TARGET) -> DataFrame:
    """All of the smaller class and, in hash order, as many rows of the larger one."""
    sizes = class_sizes(df, target)
    if len(sizes) != 2:
        raise ValueError(f"undersampling needs two classes, got {sorted(sizes)}")
    keep = min(sizes.values())
    major = max(sizes, key=lambda c: (sizes[c], c))
    chosen = hash_rank(df.filter(F.col(target) == major).select(id_col), id_col, seed).filter(F.col("hash_rank") <= keep)
    return df.filter(F.col(target) != major).unionByName(df.join(chosen.select(id_col), id_col, "left_semi"))


def resampled_size(df: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: rows and prevalence."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col(target).cast("double")).alias("prevalence"))


# -- bootstrap ---------------------------------------------------------------------------------


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bootstrap_rows(
    df: DataFrame, replicates: int, seed: int | str = 42, id_col: str = CLIENT, target: str = TARGET, bucket_rows: int = B.BUCKET_ROWS
) -> DataFrame:
    """The drawn rows with ``replicate`` and ``weight``, how often each is drawn; every class keeps its own size.

    The rows of a bucket are drawn in the task that holds them, so no draw is shuffled.
    """
    rows, plan = B.dealt(df, class_sizes(df, target), replicates, seed, id_col, target, bucket_rows)
    return B.drawn_rows(rows, plan, df.columns, id_col, _partitions(df))


def bootstrap_weights(
    df: DataFrame, replicates: int, seed: int | str = 42, id_col: str = CLIENT, target: str = TARGET, bucket_rows: int = B.BUCKET_ROWS
) -> DataFrame:
    """(replicate, id, weight) of the drawn rows."""
    return bootstrap_rows(df.select(id_col, target), replicates, seed, id_col, target, bucket_rows).select("replicate", id_col, "weight")


class WeightedMeans:
    """Statistic for the bootstrap: weighted means of the given expressions.

    Its totals are sums over rows, so the bootstrap keeps two numbers per replicate and name instead of drawn rows.
    """

    def __init__(self, names: Mapping[str, Column]):
        self.names = dict(names)

    def __call__(self, rows: DataFrame) -> DataFrame:
        g = rows.groupBy("replicate").agg(
            *[(F.sum(e * F.col("weight")) / F.sum(F.when(e.isNotNull(), F.col("weight")))).alias(n) for n, e in self.names.items()]
        )
        return g.unpivot("replicate", list(self.names), "name", "value")


weighted_means = WeightedMeans


def bootstrap_means(
    df: DataFrame, means: WeightedMeans, replicates: int, seed: int | str = 42, id_col: str = CLIENT, target: str = TARGET, bucket_rows: int = B.BUCKET_ROWS
) -> DataFrame:
    """(replicate, name, value): the weighted means of every replicate, from sums that each task keeps."""
    values = {f"_v{i}": e.cast("double") for i, e in enumerate(means.names.values())}
    rows, plan = B.dealt(df.select(id_col, target, *[e.alias(v) for v, e in values.items()]), class_sizes(df, target), replicates, seed, id_col, target, bucket_rows)
    sums = B.drawn_sums(rows, plan, values, id_col, _partitions(df))
    names = F.create_map(*[F.lit(x) for pair in zip(values, means.names) for x in pair])
    return sums.select("replicate", F.element_at(names, F.col("name")).alias("name"), F.try_divide("total", "weight").alias("value"))


def bootstrap_interval(
    df: DataFrame,
    statistic: Callable[[DataFrame], DataFrame],
    replicates: int = 2000,
    level: float = 0.95,
    seed: int | str = 42,
    id_col: str = CLIENT,
    target: str = TARGET,
    bucket_rows: int = B.BUCKET_ROWS,
) -> DataFrame:
    """Percentile interval of a statistic, scalar or many named values per replicate.

    ``statistic`` receives the rows with ``replicate`` and ``weight`` and returns
    (replicate, name, value). Two models measured on the same weights give a paired interval.
    """
    if replicates < 2 or not 0 < level < 1:
        raise ValueError(f"replicates {replicates} or level {level} not valid")
    if isinstance(statistic, WeightedMeans):
        values = bootstrap_means(df, statistic, replicates, seed, id_col, target, bucket_rows)
    else:
        values = statistic(bootstrap_rows(df, replicates, seed, id_col, target, bucket_rows))
    tail = (1 - level) / 2
    # one value per replicate and name
    q = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
    return values.groupBy("name").agg(q[0].alias("lower"), q[1].alias("upper"))


# -- fingerprints ------------------------------------------------------------------------------


def fingerprint(split: DataFrame, columns: Iterable[str] = (CLIENT, PART)) -> str:
    """Content fingerprint that does not depend on row order, layout or file format."""
    h = F.xxhash64(*[F.col(c).cast("string") for c in columns])
    row = split.agg(
        F.count(F.lit(1)).alias("n"),
        F.bit_xor(h).alias("x"),
        F.sum(F.pmod(h, F.lit(1_000_000_007))).alias("s"),
    ).first()
    return f"{row['n']}-{(row['x'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}-{row['s'] or 0}"


def bucket_digest(split: DataFrame, id_col: str = CLIENT, part: str = PART) -> DataFrame:
    """One row: sha2 over the sorted digests of 4096 hash buckets of (id, part)."""
    line = F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.col(part)))
    # each row adds the leading 12 hex digits of its hash, so the bucket digest ignores row order
    number = F.conv(F.substring(line, 1, 12), 16, 10).cast("decimal(38,0)")
    buckets = split.groupBy(F.substring(line, 30, 3).alias("b")).agg(F.sum(number).alias("s"), F.count(F.lit(1)).alias("c"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "b", "s", "c"))), ",")
    return buckets.agg(F.sum("c").alias("n_rows"), F.sha2(text, 256).alias("digest"))

