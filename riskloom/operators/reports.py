"""Composite reports that decide between two readings of the same information."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions import tails
from riskloom.functions.nullsafe import holds
from riskloom.operators.features import arrears_state
from riskloom.operators.gram import pearson
from riskloom.operators.joins import reindex
from riskloom.operators.previous import CLIENT, aggregate_previous, cleaned, denominator_counts, live_only_end, relative_recency
from riskloom.operators.ranks import prefix_by_value
from riskloom.operators.signals import TARGET, Measure, long_values, mann_whitney
from riskloom.operators.woe import conditional_iv, information_value, rate_by

# Relative readings with the absolute ones they are compared with
RELATIVE_READINGS = {
    "PREV_EXIT_REFUSED_FLAG": ("PREV_REFUSED_RATIO > 0", "PREV_REFUSED_SCOFR_FLAG"),
    "PREV_DAYS_SINCE_REFUSED_REL": ("PREV_DAYS_SINCE_REFUSED",),
    "PREV_COUNT_12M_REL": ("PREV_COUNT_12M", "PREV_APPLICATIONS_PER_YEAR"),
    "PREV_STREET_RATIO_REL": ("PREV_STREET_RATIO",),
    "PREV_EARLY_HOUR_RATIO_REL": ("PREV_EARLY_HOUR_RATIO",),
    "PREV_NO_SUITE_RATIO_REL": ("PREV_NO_SUITE_RATIO",),
}
# Recency strata in days, upper edge included
RECENCY_STRATA = {
    "todos": (None, None),
    "hasta 6m": (-180, 0),
    "6 a 12m": (-365, -180),
    "12 a 24m": (-730, -365),
    "mas de 24m": (None, -730),
}
DENOMINATOR_FEATURES = (
    "PREV_REFUSED_RATIO",
    "PREV_OVERGRANTED_RATIO",
    "PREV_STREET_RATIO",
    "PREV_NO_SUITE_RATIO",
    "PREV_EARLY_HOUR_RATIO",
    "PREV_URGENT_PURPOSE_RATIO",
)


def effects(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Per key of (keys, v, y) rows: n, rank-biserial (NULL if it cannot separate), z, p, 0/1 delta."""
    keys = list(keys)
    rows = rows.filter(F.col("v").isNotNull())
    v, y = F.col("v"), F.col("y")
    only01 = F.bool_and(v.isin(0.0, 1.0))
    delta = (F.avg(F.when(v == 1, y)) - F.avg(F.when(v == 0, y))) * 100
    shape = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.min(v) < F.max(v)).alias("varies"), F.when(only01, delta).alias("flag_delta_pp")
    )
    mw = mann_whitney(prefix_by_value(rows, "v", keys, {"bads": F.sum("y")}), keys).select(*keys, "effect", "z")
    out = shape.join(mw, keys, "left")
    return out.select(
        *keys, "n", F.when(F.col("varies"), F.col("effect")).alias("effect"), F.when(F.col("varies"), F.col("z")).alias("z"), "flag_delta_pp"
    ).withColumn("p", tails.p_normal(F.col("z")))


def effect_or_delta(df: DataFrame, items: Iterable[Measure], target: str = TARGET) -> DataFrame:
    """Effect of each measure on its reported values, and the delta when it is really a flag."""
    return effects(long_values(df, items, target), ["feature"])


def denominator_report(prev: DataFrame, train: DataFrame, cuts: Mapping | None = None, target: str = TARGET, minima: Iterable[int] = P.DENOMINATOR_MINIMA) -> DataFrame:
    """For each proportion and minimum denominator, the effect kept and the effect of what it leaves out."""
    values = aggregate_previous(prev, cuts).select(CLIENT, *DENOMINATOR_FEATURES)
    dens = denominator_counts(prev).withColumnsRenamed({c: f"den_{c}" for c in DENOMINATOR_FEATURES})
    rows = values.join(dens, CLIENT).join(train.select(CLIENT, target), CLIENT)
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), F.lit(m).alias("minimum"), F.when(F.col(f"den_{c}") >= m, "kept").otherwise("left out").alias("side"), F.col(c).cast("double").alias("v"))
            for c in DENOMINATOR_FEATURES
            for m in minima
        ]
    )
    long = rows.select(F.col(target).cast("double").alias("y"), F.explode(cells).alias("c")).select("y", "c.*")
    return effects(long, ["feature", "minimum", "side"])


def relative_recency_report(prev: DataFrame, train: DataFrame, cuts: Mapping | None = None, target: str = TARGET) -> DataFrame:
    """Relative against absolute recency: effects by recency stratum, redundancy and coverage lost."""
    rel = relative_recency(prev)
    absolute = aggregate_previous(prev, cuts)
    refused = cleaned(prev).groupBy(CLIENT).agg(
        F.max(F.when(F.col("NAME_CONTRACT_STATUS") == "Refused", F.col("DAYS_DECISION"))).alias("PREV_DAYS_SINCE_REFUSED")
    )
    rows = rel.join(absolute, CLIENT).join(refused, CLIENT).join(train.select(CLIENT, target), CLIENT)
    derived = {"PREV_REFUSED_RATIO > 0": holds(F.col("PREV_REFUSED_RATIO") > 0).cast("double")}
    recency, cells = F.col("PREV_DAYS_DECISION_MAX"), []
    for reading, others in RELATIVE_READINGS.items():
        for other in others:
            for name, (lo, hi) in RECENCY_STRATA.items():
                inside = recency.isNotNull() if lo is None and hi is None else F.lit(True)
                if lo is not None:
                    inside = inside & (recency > lo)
                if hi is not None:
                    inside = inside & (recency <= hi)
                cell = F.struct(
                    F.lit(reading).alias("reading"),
                    F.lit(other).alias("counterpart"),
                    F.lit(name).alias("stratum"),
                    F.col(reading).cast("double").alias("v"),
                    derived.get(other, F.col(f"`{other}`")).cast("double").alias("w"),
                )
                cells.append(F.when(holds(inside), cell))
    keys = ["reading", "counterpart", "stratum"]
    long = rows.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*cells)).alias("c")).filter("c IS NOT NULL").select("y", "c.*")
    cover = long.groupBy(*keys).agg(
        F.count("v").alias("n"),
        F.count_if(F.col("v").isNull() & F.col("w").isNotNull()).alias("n_abs_only"),
        F.sum("v").alias("_marked"),
        F.when(F.col("stratum") == "todos", F.abs(pearson(F.col("v"), F.col("w")))).alias("redundancy"),
    )
    kept = long.filter("v IS NOT NULL")
    both = kept.select(*keys, "y", F.explode(F.array(F.struct(F.lit("rel").alias("side"), F.col("v")), F.struct(F.lit("abs").alias("side"), F.col("w").alias("v")))).alias("s")).select(*keys, "y", "s.side", "s.v")
    flag = F.col("reading").endswith("_FLAG")
    e = effects(both, [*keys, "side"]).withColumn("value", F.when(flag, F.col("flag_delta_pp")).otherwise(F.col("effect")))

    def side(which: str, c: str) -> Column:
        return F.max(F.when(F.col("side") == which, F.col(c)))

    wide = e.groupBy(*keys).agg(
        side("rel", "value").alias("effect"), side("rel", "p").alias("p"), side("abs", "value").alias("effect_abs"), side("abs", "p").alias("p_abs")
    )
    return cover.join(wide, keys, "left").withColumn("n_marked", F.when(flag, F.col("_marked"))).drop("_marked")


# -- evidence reports --------------------------------------------------------------------------


def active_arrears_report(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Two readings of active arrears, from the sign snapshot and from the clean sum, inside the history."""
    total = F.col("BUREAU_CURRENT_OVERDUE_SUM")
    name = "BUREAU_CURRENT_OVERDUE_SUM > 0"
    rows = df.select(
        "BUREAU_HAS_CURRENT_OVERDUE", F.when(total.isNotNull(), (total > 0).cast("double")).alias(name), "HAS_BUREAU_HISTORY", target
    )
    both = ["BUREAU_HAS_CURRENT_OVERDUE", name]
    iv = conditional_iv(rows, [(c, "HAS_BUREAU_HISTORY") for c in both], target).select("feature", F.col("iv").alias("iv_without_presence"))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("v")) for c in both])
    n = rows.select(F.explode(cells).alias("c")).groupBy("c.feature").agg(F.count("c.v").alias("n"), F.sum("c.v").alias("n_marked"))
    return n.join(iv, "feature")


def arrears_state_report(df: DataFrame, target: str = TARGET, min_iv: float = P.MIN_IV) -> DataFrame:
    """Whether telling "reported as zero" from "unreported" adds to the arrears union, inside the history."""
    rows = df.filter(F.col("HAS_BUREAU_HISTORY") == 1).withColumn("tripartita", arrears_state())
    rates = rate_by(rows, F.col("tripartita").alias("level"), target=target).withColumn("iv", F.lit(None).cast("double"))
    pairs = [("BUREAU_OVERDUE_UNION", "HAS_BUREAU_HISTORY"), ("tripartita", "HAS_BUREAU_HISTORY"), ("tripartita", "BUREAU_OVERDUE_UNION")]
    iv = conditional_iv(rows, pairs, target)
    label = (
        F.when(F.col("stratum") == "BUREAU_OVERDUE_UNION", "incremental_sobre_union")
        .when(F.col("feature") == "tripartita", "tripartita")
        .otherwise("union")
    )
    return rates.unionByName(
        iv.select(label.alias("level"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("double").alias("rate"), "iv")
    )


def building_report(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Whether the building completeness count adds to its flag."""
    alone = information_value(df, ["BUILDING_INFO_COUNT"], target).select("iv").scalar()
    over = conditional_iv(df, [("BUILDING_INFO_COUNT", "HAS_BUILDING_INFO")], target).select("iv").scalar()
    return df.agg(F.sum("HAS_BUILDING_INFO").alias("n_with_data")).withColumns({"iv_marginal": alone, "iv_over_flag": over})


def live_only_report(df: DataFrame, prev: DataFrame, target: str = TARGET) -> DataFrame:
    """Planned end of all operations against that of the live ones only."""
    rows = df.join(reindex(df, live_only_end(prev)), CLIENT).select(
        "PREV_FUTURE_DUE_MAX", "PREV_FUTURE_DUE_VIVAS", "HAS_PREV_APPLICATION", target
    )
    pairs = [
        ("PREV_FUTURE_DUE_MAX", "HAS_PREV_APPLICATION"),
        ("PREV_FUTURE_DUE_VIVAS", "HAS_PREV_APPLICATION"),
        ("PREV_FUTURE_DUE_VIVAS", "PREV_FUTURE_DUE_MAX"),
    ]
    return conditional_iv(rows, pairs, target).select("feature", F.col("stratum").alias("inside"), "iv")


def score_overlap(df: DataFrame, populations: Mapping[str, Column], score: str, least: float = P.SCORE_OVERLAP) -> DataFrame:
    """Columns whose correlation with a score, inside their population, reaches the minimum."""
    names = list(populations)
    one = df.agg(*[pearson(F.col(c), F.col(score), populations[c]).alias(f"r{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r")) for i, c in enumerate(names)])
    return one.select(F.explode(cells).alias("x")).select("x.*").filter(F.abs("r") >= least)


def incremental_report(df: DataFrame, populations: Mapping[str, Column], score: str, target: str = TARGET, min_iv: float = P.MIN_IV) -> DataFrame:
    """IV of each column inside its population, alone and over a score.

    Columns of one population share a job; bins are those of the population.
    """
    groups: dict[str, tuple[Column, list[str]]] = {}
    for c, p in populations.items():
        groups.setdefault(str(p), (p, []))[1].append(c)
    out = None
    for p, columns in groups.values():
        rows = df.filter(holds(p)).select(*columns, score, target)
        alone = information_value(rows, columns, target).select("feature", F.col("iv").alias("iv_inside"))
        over = conditional_iv(rows, [(c, score) for c in columns], target).select("feature", F.col("iv").alias("iv_over_score"))
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().alias("ok")) for c in columns])
        n = rows.select(F.explode(cells).alias("c")).groupBy("c.feature").agg(F.count_if("c.ok").alias("n"))
        t = n.join(alone, "feature").join(over, "feature")
        out = t if out is None else out.unionByName(t)
    return out.withColumn("reaches", (F.col("iv_over_score") >= min_iv).cast("int"))
