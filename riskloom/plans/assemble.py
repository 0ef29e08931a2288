"""From raw tables to one row per client, and from there to the fitted matrices."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions.nullsafe import holds
from riskloom.operators import stages as S
from riskloom.operators.audits import assembly_measures
from riskloom.operators.cleaning import fix_types
from riskloom.operators.features import layer_one, require_sources
from riskloom.operators.history import CUTS as HISTORY_CUTS, aggregate_history
from riskloom.operators.joins import join_history, join_panel, join_previous, require_same_population
from riskloom.operators.panel import CUTS as PANEL_CUTS, aggregate_panel, credit_bridge
from riskloom.operators.previous import CUTS as PREVIOUS_CUTS, aggregate_previous
from riskloom.operators.selection import IvSelector, selection_register, stability
from riskloom.operators.splits import fingerprint, only, stratified_folds
from riskloom.plans.presets import Buckets
from riskloom.session import checkpointed
from riskloom.sources import artifacts as A

ID, TARGET = "SK_ID_CURR", "TARGET"


def prepare_main(app: DataFrame) -> DataFrame:
    """Layer 1 of a cleaned main table, its source columns exactly as declared."""
    require_sources(app)
    return layer_one(app)


def assemble(base: DataFrame, history: DataFrame, panel: DataFrame, prev: DataFrame, cuts: Mapping[str, object]) -> DataFrame:
    """Aggregate the three histories and join them to the clients, in the order the arrears union needs.

    The three joins share the client key, so the clients are shuffled once. An unset cut fails before
    anything runs.
    """
    unset = [c for c in P.FITTED_CUTS if cuts.get(c) is None]
    if unset:
        raise ValueError(f"cut-points not fitted: {unset}")

    def pick(names: Iterable[str]) -> dict:
        return {n: cuts[n] for n in names if n in cuts}

    h = aggregate_history(history, pick(HISTORY_CUTS))
    b = aggregate_panel(panel, credit_bridge(history), pick(PANEL_CUTS))
    p = aggregate_previous(prev, pick(PREVIOUS_CUTS))
    out = fix_types(join_history(base, h), [c for c in h.columns if c != ID])
    out = fix_types(join_panel(out, b), [c for c in b.columns if c != ID])
    return fix_types(join_previous(out, p), [c for c in p.columns if c != ID])


def feature_stages(buckets: Buckets, selector: Mapping | None = None, min_rows: int = P.MIN_CATEGORY_ROWS, smoothing: float = 20.0) -> list:
    """The fixed chain of stages: winsor, ratios, recoding, contract, encodings, constants, selection."""
    chain = [
        S.Winsorizer(),
        S.LateRatioBuilder(),
        S.DomainRecoder(),
        S.ColumnContract(columns=list(buckets.columns())),
        S.MedianImputer(columns=list(buckets.median)),
        S.RareGrouper(columns=list(buckets.onehot), min_rows=min_rows),
        S.OneHot(columns=list(buckets.onehot)),
        S.OrdinalEncoder(orders={c: list(v) for c, v in buckets.ordinal.items()}),
        S.WoeEncoder(columns=list(buckets.woe)),
        S.TargetMeanEncoder(columns=list(buckets.target_mean), smoothing=smoothing),
        S.ZeroImputer(columns=list(buckets.zero)),
        S.ConstantDropper(),
    ]
    return chain + ([IvSelector(**selector)] if selector is not None else [])


def fit_matrices(assembled: DataFrame, split: DataFrame, chain: list) -> tuple[list, DataFrame, DataFrame]:
    """Fit the chain on the training part only: (fitted stages, cross-fitted train matrix, valid matrix)."""
    fitted, train = S.fit_transform(chain, only(assembled, "train", split))
    return fitted, train, S.apply_all(fitted, only(assembled, "valid", split))


def build_artifacts(
    base: DataFrame, history: DataFrame, panel: DataFrame, prev: DataFrame, split: DataFrame, cuts: Mapping[str, object],
    buckets: Buckets, folder: str, selector: Mapping | None = None, table_of: Mapping[str, str] | None = None,
    min_rows: int = P.MIN_CATEGORY_ROWS, overwrite: bool = False,
) -> tuple[dict[str, str], DataFrame]:
    """Everything from the cleaned main table to the persisted matrices.

    All targets are checked before anything is read. The assembled table is materialised once, since
    fitting, transforming and the reports all read it. Returns the paths and the measured figures.
    """
    spark = base.sparkSession
    paths = {n: f"{folder}/{n}.parquet" for n in A.MATRICES}
    paths |= {"register": f"{folder}/seleccion.csv", "stages": f"{folder}/stages", "cuts": f"{folder}/cuts"}
    A.require_free(spark, paths.values(), overwrite)
    require_same_population(base, split, "split against the main table")
    assembled = checkpointed(assemble(base, history, panel, prev, cuts))
    selector = dict(selector or {})
    fitted, train, valid = fit_matrices(assembled, split, feature_stages(buckets, selector, min_rows))
    chooser = fitted[-1]
    before = S.apply_all(fitted[:-1], only(assembled, "train", split))
    decides = set(selector.get("candidates", {})) - set(selector.get("protected", []))
    measured = {o: v for o, v in chooser.fitted("iv").items() if o in before.columns}
    folds = stratified_folds(before)
    reached = {
        r["feature"]: r["folds_reached"] for r in stability(before, folds, measured, sorted(decides & set(measured))).collect()
    }
    register = selection_register(spark, buckets.columns(), chooser, table_of or {}, folds=reached)
    A.write_matrices(train, valid, register, folder, overwrite=overwrite)
    PipelineModel(fitted).write().overwrite().save(paths["stages"]) if overwrite else PipelineModel(fitted).save(paths["stages"])
    A.write_cuts(cuts, split, paths["cuts"], overwrite=overwrite)
    figures = assembly_measures(base, assembled).unionByName(
        spark.createDataFrame([("final columns", float(len(train.columns) - 2))], "measure string, value double")
    )
    return paths, figures


def partition_folds(assembled: DataFrame, chain_of, seeds: Iterable[int] = P.SEEDS, k: int = P.N_FOLDS):
    """Refit the chain inside every fold: (seed, k, fitting matrix, evaluation matrix).

    The fitting matrix is the cross-fitted one; the evaluation part is only transformed.
    """
    folds = stratified_folds(assembled, seeds, k)
    for seed in seeds:
        rows = checkpointed(assembled.join(folds.filter(F.col("seed") == seed).select(ID, "fold"), ID))
        for f in range(k):
            fitted, matrix = S.fit_transform(chain_of(), rows.filter(F.col("fold") != f).drop("fold"))
            yield seed, f, matrix, S.apply_all(fitted, rows.filter(F.col("fold") == f).drop("fold"))


def build_folds(assembled: DataFrame, split: DataFrame, chain_of, path: str, seeds: Iterable[int] = P.SEEDS, k: int = P.N_FOLDS, overwrite: bool = False) -> str:
    """Write the fold cache of the training part; returns the fingerprint it is tied to."""
    A.require_free(split.sparkSession, [f"{path}/{A.MANIFEST}"], overwrite)
    train, context = train_population(assembled, split)
    mark = fingerprint(split)

    def parts():
        for seed, f, fit, held in partition_folds(train, chain_of, seeds, k):
            yield seed, f, "fit", fit
            yield seed, f, "eval", held

    A.write_folds(parts(), context, mark, path, overwrite)
    return mark


def train_population(assembled: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training clients with layer 1, and what the evaluation needs of each."""
    train = only(assembled, "train", split)
    require_same_population(train, split.filter(F.col("split") == "train"), "training part")
    return train, train.select(ID, TARGET, "AMT_CREDIT", "HAS_BUREAU_HISTORY")


def absence_recovery(df: DataFrame, rules: Mapping[str, object]) -> DataFrame:
    """For each imputed column: missing rows, those another column gives away, and the residual."""
    columns = list(rules)
    aggs = []
    for i, c in enumerate(columns):
        gap, told = F.col(c).isNull(), holds(rules[c])
        aggs += [F.count_if(gap).alias(f"m{i}"), F.count_if(gap & told).alias(f"t{i}"), F.count_if(gap & ~told).alias(f"r{i}")]
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.col(f"m{i}").alias("missing"), F.col(f"t{i}").alias("recovered"), F.col(f"r{i}").alias("residual"))
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.explode(cells).alias("x")).select("x.*")
