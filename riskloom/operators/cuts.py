"""Cut-points of the aggregations, fitted on the training part only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions.nullsafe import as_double, count_of, flag_where
from riskloom.operators.binning import bin_index
from riskloom.operators.cleaning import clean_history
from riskloom.operators.features import grant_ratio, is_recent, purpose_declared, term_end_date
from riskloom.operators.history import CLIENT, NUMBERS as HISTORY_NUMBERS
from riskloom.operators.joins import inherit
from riskloom.operators.panel import CREDIT
from riskloom.operators.previous import cleaned
from riskloom.operators.ranks import exact_quantiles
from riskloom.operators.signals import Measure, flag_signal, rank_signal

TARGET = "TARGET"


def cut_levels(clients: DataFrame, count: str = "n", target: str = TARGET, start: int = 2) -> DataFrame:
    """Delta of the flag "count >= cut" for every range of cuts that gives the same flag.

    Rows: first and last integer cut of the range, clients marked and delta in points. There is one row
    per distinct count, and k distinct counts need at least k squared over two history rows, so
    the table is small whatever the history.
    """
    levels = clients.groupBy(F.col(count).cast("bigint").alias("level")).agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col(target).cast("double")).alias("bads")
    )
    up = Window.partitionBy(F.lit(0)).orderBy("level")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    rows = levels.withColumns(
        {
            "_n0": F.coalesce(F.sum("c").over(before), F.lit(0)),
            "_b0": F.coalesce(F.sum("bads").over(before), F.lit(0.0)),
            "_n": F.sum("c").over(whole),
            "_b": F.sum("bads").over(whole),
            "_prev": F.lag("level").over(up),
        }
    )
    marked = F.col("_n") - F.col("_n0")
    delta = ((F.col("_b") - F.col("_b0")) / marked - F.try_divide("_b0", "_n0")) * 100
    first = F.greatest(F.lit(start), F.coalesce(F.col("_prev") + 1, F.lit(start))).cast("bigint")
    return rows.select(
        first.alias("first_cut"), F.col("level").alias("last_cut"), marked.alias("marked"), delta.alias("delta_pp")
    ).filter(F.col("first_cut") <= F.col("last_cut"))


def cut_sweep(clients: DataFrame, count: str = "n", target: str = TARGET, start: int = 2, threshold: float = P.MIN_FLAG_DELTA_PP) -> DataFrame:
    """The sweep over every integer cut, with the first one that crosses marked."""
    levels = cut_levels(clients, count, target, start)
    chosen = levels.filter(F.col("delta_pp") >= threshold).agg(F.min("first_cut").alias("v")).scalar()
    every = F.explode(F.sequence("first_cut", "last_cut"))
    return levels.select(every.alias("cut"), "marked", "delta_pp").withColumn(
        "chosen", F.coalesce(F.col("cut") == chosen, F.lit(False)).cast("int")
    )


def first_crossing(clients: DataFrame, count: str = "n", target: str = TARGET, start: int = 2, threshold: float = P.MIN_FLAG_DELTA_PP, strict: bool = True) -> int | None:
    """Smallest integer cut whose flag delta reaches the threshold; when none does, fails if strict."""
    row = cut_levels(clients, count, target, start).filter(F.col("delta_pp") >= threshold).agg(F.min("first_cut").alias("v")).first()
    if row["v"] is None and strict:
        raise ValueError("no cut of the count crosses the flag threshold")
    return None if row["v"] is None else int(row["v"])


# -- populations of the fits -------------------------------------------------------------------


def train_history(history: DataFrame, train: DataFrame, target: str = TARGET) -> DataFrame:
    """Cleaned history rows of labelled training clients."""
    return inherit(clean_history(as_double(history, [c for c in HISTORY_NUMBERS if c in history.columns])), train, target)


def train_previous(prev: DataFrame, train: DataFrame, target: str = TARGET) -> DataFrame:
    """Cleaned previous applications of labelled training clients."""
    return inherit(cleaned(prev), train, target)


def history_counts(rows: DataFrame, target: str = TARGET) -> DataFrame:
    """(client, n, target): rows per client."""
    return rows.groupBy(CLIENT).agg(F.count(F.lit(1)).alias("n"), F.max(target).alias(target))


def panel_counts(panel: DataFrame, bridge: DataFrame, train: DataFrame, target: str = TARGET) -> DataFrame:
    """(client, n, target): credits with panel and a known parent, per training client."""
    credits = bridge.join(panel.select(CREDIT).distinct(), CREDIT, "left_semi")
    return history_counts(inherit(credits, train, target), target)


def recent_counts(rows: DataFrame, window: float = P.RECENT_WINDOW_DAYS, target: str = TARGET) -> DataFrame:
    """(client, n, target): applications inside the window, zero included."""
    return rows.groupBy(CLIENT).agg(count_of(is_recent(window)).alias("n"), F.max(target).alias(target))


# -- the eight cuts ----------------------------------------------------------------------------


def end_date_rates(rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Default rate of term credits by bin of their planned end, empty bins included, peak marked."""
    edges = P.END_DATE_GRID
    years = term_end_date() / P.DAYS_PER_YEAR
    binned = rows.select(years.alias("years"), F.col(target).cast("double").alias("y")).filter(F.col("years").isNotNull())
    g = binned.groupBy(bin_index(F.col("years"), edges).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    lows, highs = (None, *edges), (*edges, None)
    grid = rows.sparkSession.createDataFrame(
        [(i, lo, hi) for i, (lo, hi) in enumerate(zip(lows, highs))], "bin int, low double, high double"
    )
    t = grid.join(g, "bin", "left").fillna(0, subset=["n"])
    top = Window.partitionBy(F.lit(0)).orderBy(F.col("rate").desc_nulls_last(), "bin")
    return t.withColumn("peak", (F.row_number().over(top) == 1).cast("int"))


def fit_end_date_bin(rows: DataFrame, target: str = TARGET, strict: bool = True) -> tuple[float, float]:
    """Edges, in years, of the peak bin; a peak in the past fails if strict."""
    row = end_date_rates(rows, target).filter("peak = 1").first()
    low = float("-inf") if row["low"] is None else row["low"]
    if low < 0 and strict:
        raise ValueError(f"the default rate peaks in the past: up to {row['high']} years")
    return low, float("inf") if row["high"] is None else row["high"]


def overgrant_sweep(rows: DataFrame, target: str = TARGET) -> DataFrame:
    """Effect of the per-client share of over-granted applications for each cut of the grid."""
    grant = grant_ratio()
    names = {c: f"share_{i}" for i, c in enumerate(P.OVERGRANT_GRID)}
    clients = rows.groupBy(CLIENT).agg(
        *[F.avg(flag_where(grant > c, grant.isNotNull())).alias(n) for c, n in names.items()], F.max(target).alias(target)
    )
    label = {c: f"{c:g}" for c in names}
    effect = rank_signal(clients, [Measure(label[c], F.col(n), None, "") for c, n in names.items()], target)
    # a share that never varies separates nothing
    spread = clients.agg(*[(F.min(n) < F.max(n)).alias(n) for n in names.values()])
    varies = F.create_map(*[x for c, n in names.items() for x in (F.lit(label[c]), F.col(n))])
    table = spread.select(F.explode(varies).alias("feature", "varies"))
    delta = flag_signal(
        clients,
        [Measure(label[c], F.when(F.col(n).isNotNull(), (F.col(n) > 0).cast("double")), None, "") for c, n in names.items()],
        target,
    )
    top = Window.partitionBy(F.lit(0)).orderBy(F.col("effect").desc_nulls_last(), "cut")
    return (
        effect.join(table, "feature")
        .join(delta.select("feature", F.col("effect").alias("flag_delta_pp")), "feature", "left")
        .select(
            F.col("feature").cast("double").alias("cut"), "n", F.when(F.col("varies"), F.col("effect")).alias("effect"), "flag_delta_pp"
        )
        .withColumn("chosen", (F.row_number().over(top) == 1).cast("int"))
    )


def purpose_rates(rows: DataFrame, target: str = TARGET, min_rows: int = P.MIN_CATEGORY_ROWS, threshold: float = P.MIN_FLAG_DELTA_PP) -> DataFrame:
    """Default rate of each declared purpose against all declared ones, with the chosen ones marked."""
    said = rows.filter(purpose_declared())
    g = said.groupBy(F.col("NAME_CASH_LOAN_PURPOSE").alias("purpose")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("double")).alias("bads")
    )
    overall = g.agg(F.sum("bads") / F.sum("n")).scalar()
    t = g.withColumns({"rate": F.col("bads") / F.col("n") * 100, "delta_pp": (F.col("bads") / F.col("n") - overall) * 100})
    return t.drop("bads").withColumn("chosen", ((F.col("n") >= min_rows) & (F.col("delta_pp") >= threshold)).cast("int"))


def fit_purposes(rows: DataFrame, target: str = TARGET, min_rows: int = P.MIN_CATEGORY_ROWS, threshold: float = P.MIN_FLAG_DELTA_PP, strict: bool = True) -> tuple[str, ...] | None:
    """Sorted list of the purposes that stand out; none fails if strict."""
    chosen = purpose_rates(rows, target, min_rows, threshold).filter("chosen = 1").agg(F.array_sort(F.collect_set("purpose")).alias("v")).first()["v"]
    if not chosen and strict:
        raise ValueError("no purpose stands out with enough rows")
    return tuple(chosen) or None


def fit_auxiliary_cuts(
    history: DataFrame, panel: DataFrame, prev: DataFrame, bridge: DataFrame, train: DataFrame, target: str = TARGET,
    min_rows: int = P.MIN_CATEGORY_ROWS, threshold: float = P.MIN_FLAG_DELTA_PP, strict: bool = True,
) -> dict[str, object]:
    """All eight cuts, from the rows of the training clients.

    A cut that the data do not support fails the fit; unless strict, it is unset (a peak in the past is given as it is).
    """
    rows, apps = train_history(history, train, target), train_previous(prev, train, target)
    low, high = fit_end_date_bin(rows, target, strict)
    best = overgrant_sweep(apps, target).filter("chosen = 1").first()
    return {
        "bureau_enddate_tramo_min_anios": low,
        "bureau_enddate_tramo_max_anios": high,
        "bureau_count_cola": first_crossing(history_counts(rows, target), target=target, threshold=threshold, strict=strict),
        "bb_many_credits_corte": first_crossing(panel_counts(panel, bridge, train, target), target=target, threshold=threshold, strict=strict),
        "prev_count_cola": first_crossing(history_counts(apps, target), target=target, threshold=threshold, strict=strict),
        "prev_actividad_12m_cola": first_crossing(recent_counts(apps, target=target), target=target, start=1, threshold=threshold, strict=strict),
        "prev_sobreconcesion_corte": float(best["cut"]),
        "prev_finalidades_urgentes": fit_purposes(apps, target, min_rows, threshold, strict),
    }


def p99_plus_one(clients: DataFrame, count: str = "n") -> int:
    """First integer above the 99th percentile of a count, the contrast of the panel cut."""
    return int(exact_quantiles(clients, [count], [0.99])[(count,)][0]) + 1


def require_all_cuts(cuts: Mapping[str, object]) -> None:
    """Exactly the eight fitted cuts, none unset."""
    unset = [n for n in P.FITTED_CUTS if cuts.get(n) is None]
    extra = sorted(set(cuts) - set(P.FITTED_CUTS))
    if unset or extra:
        raise ValueError(f"cut-points: not fitted {unset}, unexpected {extra}")
