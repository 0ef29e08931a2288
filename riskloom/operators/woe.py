"""Weight of evidence and information value, many columns per job.

Rows are turned into (feature, stratum, bin) counts by one partial aggregate; the rest is closed form
over those counts. Positive evidence means more risk than the average. Each bin gets a prior of
``alpha`` rows split by the rate of its stratum, so a small bin converges to no evidence.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.operators.binning import Bins, fit_bins

TARGET = "TARGET"


def bin_counts(
    df: DataFrame,
    labels: Mapping[str, Column],
    target: str = TARGET,
    strata: Mapping[str, Column] | None = None,
    where: Mapping[str, Column] | None = None,
    by: Iterable[str] = (),
) -> DataFrame:
    """(by, feature, stratum, bin, n, bads): counts of every feature in one aggregate.

    ``strata`` gives the stratum label of a feature, ``where`` its population.
    """
    strata, where, by = dict(strata or {}), dict(where or {}), list(by)
    cells = []
    for name, label in labels.items():
        cell = F.struct(
            F.lit(name).alias("feature"),
            strata.get(name, F.lit("all")).cast("string").alias("stratum"),
            label.cast("string").alias("bin"),
        )
        cells.append(F.when(where[name], cell) if name in where else cell)
    y = F.col(target)
    return (
        df.filter(y.isNotNull())
        .select(*by, y.cast("double").alias("_y"), F.explode(F.array(*cells)).alias("c"))
        .filter(F.col("c").isNotNull())
        .groupBy(*by, "c.feature", "c.stratum", "c.bin")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("bads"))
    )


def woe_table(counts: DataFrame, alpha: float = P.WOE_PRIOR_ROWS, by: Iterable[str] = ()) -> DataFrame:
    """Evidence of each bin; NULL where its stratum holds one class only."""
    w = Window.partitionBy(*by, "feature", "stratum")
    t = counts.withColumn("goods", F.col("n") - F.col("bads")).withColumns(
        {"_b": F.sum("bads").over(w), "_g": F.sum("goods").over(w), "_n": F.sum("n").over(w)}
    )
    prior = F.lit(float(alpha)) * F.col("_b") / F.col("_n")
    t = t.withColumns(
        {
            "part_bads": F.try_divide(F.col("bads") + prior, F.col("_b")),
            "part_goods": F.try_divide(F.col("goods") + alpha - prior, F.col("_g")),
        }
    )
    both = (F.col("_b") > 0) & (F.col("_g") > 0)
    woe = F.when(both, F.ln(F.try_divide("part_bads", "part_goods")))
    return t.withColumn("woe", woe).withColumn(
        "iv", (F.col("part_bads") - F.col("part_goods")) * F.col("woe")
    ).withColumnRenamed("_n", "n_stratum").drop("_b", "_g")


def iv_of(table: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """IV per feature: strata weighted by their share of rows, one-class strata counting zero."""
    by = list(by)
    per_stratum = table.groupBy(*by, "feature", "stratum").agg(
        F.first("n_stratum").alias("n"), F.coalesce(F.sum("iv"), F.lit(0.0)).alias("iv"), F.count(F.lit(1)).alias("bins")
    )
    return per_stratum.groupBy(*by, "feature").agg(
        (F.sum(F.col("iv") * F.col("n")) / F.sum("n")).alias("iv"),
        F.sum("n").alias("n"),
        F.max("bins").alias("n_bins"),
    )


def information_value(
    df: DataFrame,
    columns: Iterable[str],
    target: str = TARGET,
    bins: Mapping[str, Bins] | None = None,
    where: Mapping[str, Column] | None = None,
    alpha: float = P.WOE_PRIOR_ROWS,
    by: Iterable[str] = (),
) -> DataFrame:
    """IV of many columns in one job, each inside its population."""
    columns = list(columns)
    bins = bins or fit_bins(df, columns)
    counts = bin_counts(df, {c: bins[c].label() for c in columns}, target, None, where, by)
    return iv_of(woe_table(counts, alpha, by), by)


def conditional_iv(
    df: DataFrame,
    pairs: Iterable[tuple[str, str]],
    target: str = TARGET,
    where: Mapping[str, Column] | None = None,
    alpha: float = P.WOE_PRIOR_ROWS,
    bins: Mapping[str, Bins] | None = None,
) -> DataFrame:
    """(feature, stratum column, iv): IV of a column inside the bins of another, many pairs per job.

    Bins are fixed over the whole frame, so they do not change from stratum to stratum.
    """
    pairs = list(pairs)
    bins = bins or fit_bins(df, [c for p in pairs for c in p])
    sep = " | "
    labels = {f"{a}{sep}{b}": bins[a].label() for a, b in pairs}
    strata = {f"{a}{sep}{b}": bins[b].label() for a, b in pairs}
    renamed = {f"{a}{sep}{b}": where[a] for a, b in pairs if where and a in where}
    iv = iv_of(woe_table(bin_counts(df, labels, target, strata, renamed), alpha))
    parts = F.split("feature", r" \| ")
    return iv.select(parts[0].alias("feature"), parts[1].alias("stratum"), "iv", "n", "n_bins")


def iv_report(
    df: DataFrame, candidates: Mapping[str, str | None], target: str = TARGET, min_iv: float = P.MIN_IV
) -> DataFrame:
    """Each candidate's IV, alone and without the signal of its table's presence."""
    lacking = [c for c in [*candidates, target] if c not in df.columns]
    if lacking:
        raise KeyError(f"IV candidates missing from the frame: {lacking}")
    sources = sorted({p for p in candidates.values() if p})
    bins = fit_bins(df, [*candidates, *sources])
    marginal = information_value(df, candidates, target, bins)
    pairs = [(c, p) for c, p in candidates.items() if p]
    if pairs:
        inside = conditional_iv(df, pairs, target, bins=bins).select("feature", F.col("iv").alias("iv_without_presence"))
        table = marginal.join(inside, "feature", "left")
    else:
        table = marginal.withColumn("iv_without_presence", F.lit(None).cast("double"))
    two = [c for c in candidates if bins[c].edges is None and c in {f.name for f in df.schema.fields if f.dataType.typeName() != "string"}]
    filled = _filled(df, candidates, two)
    reading = F.coalesce("iv_without_presence", "iv")
    return table.drop("n").join(filled, "feature").withColumns(
        {"iv_reading": reading, "reaches": (reading >= min_iv).cast("int")}
    )


def _filled(df: DataFrame, columns: Iterable[str], flags: Iterable[str]) -> DataFrame:
    """(feature, n, n_marked): reported rows, and the total of the flags."""
    flags = set(flags)
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(c).isNotNull().alias("ok"),
            (F.col(c).cast("double") if c in flags else F.lit(None).cast("double")).alias("v"),
        )
        for c in columns
    ]
    return (
        df.select(F.explode(F.array(*cells)).alias("c"))
        .groupBy("c.feature")
        .agg(F.count_if("c.ok").alias("n"), F.sum("c.v").alias("n_marked"))
    )


def rate_by(df: DataFrame, *groups: str | Column, target: str = TARGET) -> DataFrame:
    """n and mean target by group."""
    return df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(target).cast("double")).alias("rate"))
