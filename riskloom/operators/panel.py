"""Monthly panel: credit-month to credit, then credit to client.

Two shuffles, the second over one row per credit. Everything about the months of a credit, its
half-window trajectory included, is kept as bits of the 97-month domain inside one hash aggregate, so
rows are combined before the shuffle and never sorted.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions.nullsafe import any_of, as_flag, holds, ratio, require_columns
from riskloom.operators.cleaning import FIRST_REPORTED, IS_ARREARS, IS_BLIND, PANEL_STATES, SEVERITY, clean_panel, state_position
from riskloom.operators.history import resolve_cuts

CREDIT, CLIENT = "SK_ID_BUREAU", "SK_ID_CURR"
MONTH, STATUS = "MONTHS_BALANCE", "STATUS"
DEFAULT_CUTS = {
    "bb_min_meses_reportados": P.MIN_REPORTED_MONTHS,
    "bb_mora_reciente_meses": P.RECENT_ARREARS_MONTHS,
    "bb_min_meses_trayectoria": P.MIN_TRAJECTORY_MONTHS,
}
CUTS = (*DEFAULT_CUTS, "bb_many_credits_corte")
CREDIT_CUTS = ("bb_min_meses_trayectoria",)
CLIENT_CUTS = ("bb_min_meses_reportados", "bb_mora_reciente_meses", "bb_many_credits_corte")
# Trajectories from best to worst
TRAJECTORIES = ("sin mora", "mejora", "empeora", "estable")
TRAJECTORY_FLAGS = {
    "BB_PERSISTENT_DPD_FLAG": "estable",
    "BB_WORSENING_DPD_FLAG": "empeora",
    "BB_RECOVERED_DPD_FLAG": "mejora",
}
PANEL_FLAGS = (
    "BB_ANY_DPD_FLAG",
    "BB_RECENT_DPD_FLAG",
    "BB_RECENT_DPD_FLAG_REL",
    "BB_WRITEOFF_FLAG",
    "BB_EXITS_IN_DPD_FLAG",
    "BB_ALL_CLOSED_FLAG",
    "BB_MANY_CREDITS_FLAG",
    *TRAJECTORY_FLAGS,
    "BB_OVERDUE_UNION",
)


def populations() -> dict[str, Column | None]:
    """Named populations over the joined client frame; None is the one of the measure itself."""
    return {
        "global": None,
        "no nulos (auto-cond.)": None,
        "con histórico": F.col("HAS_BUREAU_BALANCE") == 1,
        "con historial de bureau": F.col("HAS_BUREAU_HISTORY") == 1,
        "trayectoria evaluable": F.col("BB_TRAJECTORY").isNotNull(),
        "con estado reportado": F.col("BB_STATUS_WORST").isNotNull(),
        "clientes con mora": F.col("BB_ANY_DPD_FLAG") == 1,
    }


def with_window(panel: DataFrame, credit: str = CREDIT, month: str = MONTH) -> DataFrame:
    """First and last month of the credit on each of its rows."""
    w = Window.partitionBy(credit)
    return panel.withColumns({"_ini": F.min(month).over(w), "_fin": F.max(month).over(w)})


def is_recent_half(month: str = MONTH) -> Column:
    """Second half of the window; the middle month of an odd window stays in the first."""
    return F.col(month) - F.col("_ini") > F.col("_fin") - F.col(month)


def trajectory_code(old: Column, recent: Column, evaluable: Column) -> Column:
    """Position of the trajectory in TRAJECTORIES; NULL when it cannot be judged."""
    code = (
        F.when((old == 0) & (recent == 0), 0).when(recent < old, 1).when(recent > old, 2).otherwise(3)
    )
    return F.when(evaluable & old.isNotNull() & recent.isNotNull(), code)


def trajectory_label(code: Column) -> Column:
    """Name of a trajectory code."""
    return F.get(F.array(*[F.lit(t) for t in TRAJECTORIES]), code.cast("int"))


def packed_state(month: str = MONTH, status: str = STATUS) -> Column:
    """Month and state in one integer, so the last state is a plain maximum kept in a hash aggregate."""
    return (F.col(month) - P.PANEL_MONTHS[0]) * len(PANEL_STATES) + state_position(status)


def unpacked_state(packed: Column) -> Column:
    """State of a packed (month, state)."""
    return F.substring(F.lit("".join(PANEL_STATES)), packed % len(PANEL_STATES) + 1, F.lit(1))


# months back from the application, in two longs: 0..61 and 62..96, so that the sum of two words is a long
WORD = 62


def month_words(month: str = MONTH) -> dict[str, Column]:
    """The month of a row as one bit of two longs, computed once per row."""
    back = -F.col(month).cast("int")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return {
        "_low": F.when(back < WORD, F.call_function("shiftleft", one, back)).otherwise(none),
        "_high": F.when(back >= WORD, F.call_function("shiftleft", one, back - WORD)).otherwise(none),
    }


def distinct_months(month: str = MONTH) -> Column:
    """Aggregate: distinct months of a group."""
    words = month_words(month)
    return F.bit_count(F.bit_or(words["_low"])) + F.bit_count(F.bit_or(words["_high"]))


def newer_bits(middle: Column) -> tuple[Column, Column]:
    """Bits of the months less than ``middle`` months back."""
    one = F.lit(1).cast("bigint")
    full = F.lit(2**WORD - 1).cast("bigint")
    low = F.when(middle >= WORD, full).otherwise(F.call_function("shiftleft", one, F.least(middle, F.lit(WORD))) - 1)
    high = F.when(middle > WORD, F.call_function("shiftleft", one, middle - WORD) - 1).otherwise(F.lit(0).cast("bigint"))
    return low, high


def worst_level(levels: list[tuple[Column, Column]], keep: tuple[Column, Column]) -> Column:
    """Highest severity with a month among the kept bits; NULL without any."""
    hits = [F.when((lo.bitwiseAND(keep[0]) != 0) | (hi.bitwiseAND(keep[1]) != 0), float(i)) for i, (lo, hi) in enumerate(levels)]
    return F.coalesce(*reversed(hits))


def guard_months(panel: DataFrame, credit: str = CREDIT, month: str = MONTH) -> DataFrame:
    """Per credit: rows, window and whether it has gaps or repeated months."""
    g = panel.groupBy(credit).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(month).alias("ini"),
        F.max(month).alias("fin"),
        distinct_months(month).alias("n_months"),
    )
    length = F.col("fin") - F.col("ini") + 1
    return g.withColumns(
        {"has_gap": (length != F.col("n_months")).cast("int"), "has_repeat": (F.col("n_rows") != F.col("n_months")).cast("int")}
    )


def broken_windows(panel: DataFrame) -> DataFrame:
    """Credits whose monthly window has a gap or a repeated month."""
    return guard_months(panel).filter((F.col("has_gap") == 1) | (F.col("has_repeat") == 1))


def aggregate_credits(
    panel: DataFrame, cuts: Mapping[str, float] | None = None, check: bool = True
) -> DataFrame:
    """One row per credit of the panel. A gap, a repeated month or a missing key fails the query."""
    require_columns(panel, (CREDIT, MONTH, STATUS), "monthly panel")
    c = resolve_cuts(cuts, DEFAULT_CUTS, CUTS, CREDIT_CUTS, "monthly panel")
    rows = clean_panel(panel).withColumns({**month_words(), "_pos": state_position()})
    sev, late, pos, none = F.col(SEVERITY), F.col(IS_ARREARS), F.col("_pos"), F.lit(0).cast("bigint")
    bits = {}
    for i in range(len(PANEL_STATES) - FIRST_REPORTED):
        at = pos == i + FIRST_REPORTED
        bits[f"_lo{i}"] = F.bit_or(F.when(at, F.col("_low")).otherwise(none))
        bits[f"_hi{i}"] = F.bit_or(F.when(at, F.col("_high")).otherwise(none))
    g = rows.groupBy(CREDIT).agg(
        F.count(F.lit(1)).alias("BB_MONTHS_OBS"),
        F.count(sev).alias("BB_MONTHS_REPORTED"),
        F.max(sev).alias("BB_WORST"),
        F.avg(IS_BLIND).alias("BB_PCT_X"),
        F.min(MONTH).alias("BB_WINDOW_INI"),
        F.max(MONTH).alias("BB_WINDOW_END"),
        F.sum(late).alias("_late"),
        F.max((F.col(MONTH) - P.PANEL_MONTHS[0]) * len(PANEL_STATES) + pos).alias("_last"),
        F.max(F.when(late == 1, F.col(MONTH))).cast("double").alias("BB_LAST_DPD_MONTH"),
        (F.bit_count(F.bit_or("_low")) + F.bit_count(F.bit_or("_high"))).alias("_months"),
        *[e.alias(n) for n, e in bits.items()],
    )
    length = F.col("BB_WINDOW_END") - F.col("BB_WINDOW_INI") + 1
    broken = (length != F.col("BB_MONTHS_OBS")) | (F.col("_months") != F.col("BB_MONTHS_OBS"))
    broken = broken | F.col(CREDIT).isNull()
    if check:
        message = F.concat(F.lit("broken monthly window or key: "), F.coalesce(F.col(CREDIT).cast("string"), F.lit("NULL")))
        g = g.withColumn("BB_MONTHS_OBS", F.when(broken, F.raise_error(message).cast("bigint")).otherwise(F.col("BB_MONTHS_OBS")))
    arrears = F.when(F.col("BB_MONTHS_REPORTED") > 0, F.col("_late").cast("double"))
    # a month is recent when it is nearer the end: fewer months back than the middle of the window
    middle = F.call_function("div", 1 - F.col("BB_WINDOW_INI") - F.col("BB_WINDOW_END"), F.lit(2)).cast("int")
    newer = newer_bits(middle)
    older = tuple(F.bitwise_not(x) for x in newer)
    levels = [(F.col(f"_lo{i}"), F.col(f"_hi{i}")) for i in range(len(PANEL_STATES) - FIRST_REPORTED)]
    g = g.withColumns({"BB_WORST_OLD_HALF": worst_level(levels, older), "BB_WORST_RECENT_HALF": worst_level(levels, newer)})
    old, new = F.col("BB_WORST_OLD_HALF"), F.col("BB_WORST_RECENT_HALF")
    enough = F.col("BB_MONTHS_OBS") >= c["bb_min_meses_trayectoria"]
    return g.withColumns(
        {
            "BB_DPD_MONTHS": arrears,
            "BB_PCT_DPD": ratio(arrears, "BB_MONTHS_REPORTED"),
            "BB_CENSORED": (F.col("BB_WINDOW_END") < 0).cast("int"),
            "BB_LAST_STATUS": unpacked_state(F.col("_last")),
            "BB_CREDIT_TRAJECTORY": trajectory_code(old, new, enough),
        }
    ).drop("_late", "_months", "_last", *bits)


def credit_bridge(history: DataFrame) -> DataFrame:
    """Credit -> client. A missing, fractional or repeated key fails the query."""
    require_columns(history, (CREDIT, CLIENT), "bridge")
    key = F.col(CREDIT)
    fractional = key.cast("double") != F.floor(key.cast("double"))
    bad = key.isNull() | F.col(CLIENT).isNull() | fractional
    g = (
        history.select(CREDIT, CLIENT, bad.alias("_bad"))
        .groupBy(CREDIT)
        .agg(F.count(F.lit(1)).alias("_n"), F.bool_or("_bad").alias("_bad"), F.max(CLIENT).alias(CLIENT))
    )
    message = F.concat(F.lit("bridge key missing, fractional or repeated: "), F.coalesce(key.cast("string"), F.lit("NULL")))
    ok = (F.col("_n") == 1) & ~F.col("_bad")
    return g.select(
        F.when(ok, key).otherwise(F.raise_error(message).cast("bigint")).cast("bigint").alias(CREDIT), CLIENT
    )


def attach_clients(credits: DataFrame, bridge: DataFrame) -> DataFrame:
    """Credits with a known client; orphans drop out."""
    return credits.join(bridge, CREDIT, "inner")


def client_aggregates(c: Mapping[str, float]) -> dict[str, Column]:
    """Column -> aggregate over one row per credit."""
    late = holds(F.col("BB_DPD_MONTHS") > 0)
    reported = F.col("BB_DPD_MONTHS").isNotNull()
    last = F.col("BB_LAST_STATUS")
    gap = F.col("BB_LAST_DPD_MONTH") - F.col("BB_WINDOW_END")
    recent = -c["bb_mora_reciente_meses"]
    n, code = F.count(F.lit(1)), F.max("BB_CREDIT_TRAJECTORY")
    months, reported_months = F.sum("BB_DPD_MONTHS"), F.sum("BB_MONTHS_REPORTED")
    return {
        "BB_N_CREDITS_WBAL": n,
        "BB_MONTHS_TOTAL": F.sum("BB_MONTHS_OBS"),
        "BB_MONTHS_REPORTED": reported_months,
        "BB_STATUS_WORST": F.max("BB_WORST"),
        "BB_ANY_DPD_FLAG": any_of(late),
        "BB_RECENT_DPD_FLAG": any_of(F.col("BB_LAST_DPD_MONTH") >= recent),
        "BB_WRITEOFF_FLAG": any_of(F.col("BB_WORST") == 5),
        "BB_MONTHS_SINCE_LAST_DPD": F.max("BB_LAST_DPD_MONTH"),
        "BB_CENSORED_RATIO": F.avg("BB_CENSORED"),
        "BB_MONTHS_SINCE_LAST_DPD_REL": F.max(gap),
        "BB_EXITS_IN_DPD_FLAG": any_of(last.isin("1", "2", "3", "4", "5")),
        "BB_ALL_CLOSED_FLAG": F.bool_and(holds(last == "C")).cast("int"),
        "BB_TRAJECTORY": trajectory_label(code),
        "BB_CREDITS_WITH_DPD_COUNT": F.sum(F.when(reported, late.cast("double"))),
        "BB_DPD_MONTHS_COUNT": months,
        "BB_PCT_MONTHS_DPD": F.when(reported_months >= c["bb_min_meses_reportados"], months / reported_months),
        "BB_RECENT_DPD_FLAG_REL": F.coalesce(F.max(gap) >= recent, F.lit(False)).cast("int"),
        "BB_MANY_CREDITS_FLAG": (n >= c["bb_many_credits_corte"]).cast("int"),
        **{
            flag: (code == TRAJECTORIES.index(kind)).cast("double") for flag, kind in TRAJECTORY_FLAGS.items()
        },
    }


def aggregate_panel(panel: DataFrame, bridge: DataFrame, cuts: Mapping[str, float] | None = None) -> DataFrame:
    """One row per client with monthly panel: credits, bridge, clients."""
    c = resolve_cuts(cuts, DEFAULT_CUTS, CUTS, CLIENT_CUTS, "monthly panel")
    credits = attach_clients(aggregate_credits(panel, cuts), bridge)
    return credits.groupBy(CLIENT).agg(*[e.alias(n) for n, e in client_aggregates(c).items()])


# -- ordered views of the panel ----------------------------------------------------------------


def in_order(credit: str = CREDIT, month: str = MONTH):
    """Window over the months of a credit."""
    return Window.partitionBy(credit).orderBy(month)


def with_next_state(panel: DataFrame) -> DataFrame:
    """Next state of the credit and whether it is the very next month."""
    w = in_order()
    return panel.withColumns(
        {
            "next_status": F.lead(STATUS).over(w),
            "is_consecutive": as_flag(F.lead(MONTH).over(w) - F.col(MONTH) == 1),
        }
    )


def state_months(panel: DataFrame, sets: Mapping[str, Iterable[str]], extra: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per credit: the months of each set of states as two longs (``<name>_lo``, ``<name>_hi``), without sorting.

    The sets are disjoint. Equal rows count once; a month in two of the sets has no order and fails the query.
    """
    rows = panel.withColumns(month_words())
    none, bits = F.lit(0).cast("bigint"), {}
    for name, states in sets.items():
        here = F.col(STATUS).isin(*states)
        bits[f"{name}_lo"] = F.bit_or(F.when(here, F.col("_low")).otherwise(none))
        bits[f"{name}_hi"] = F.bit_or(F.when(here, F.col("_high")).otherwise(none))
    g = rows.groupBy(CREDIT).agg(*[e.alias(n) for n, e in (bits | dict(extra or {})).items()])
    counted = reduce(add, [F.bit_count(n) for n in bits])
    joined = [F.bit_count(reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"{n}_{w}") for n in sets])) for w in ("lo", "hi")]
    message = F.concat(F.lit("two states in one month of the panel: "), F.coalesce(F.col(CREDIT).cast("string"), F.lit("NULL")))
    first = next(iter(bits))
    return g.withColumn(first, F.when(counted == joined[0] + joined[1], F.col(first)).otherwise(F.raise_error(message).cast("bigint")))


def months_of(*names: str) -> tuple[Column, Column]:
    """Months in any of the named sets of ``state_months``."""
    return tuple(reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"{n}_{w}") for n in names]) for w in ("lo", "hi"))


def month_before(months: tuple[Column, Column]) -> tuple[Column, Column]:
    """The month before each of the months: one more month back."""
    low, high = months
    up = F.call_function("shiftleft", low, F.lit(1)).bitwiseAND(F.lit(2**WORD - 1))
    return up, F.call_function("shiftleft", high, F.lit(1)).bitwiseOR(F.call_function("shiftright", low, F.lit(WORD - 1)))


def both(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """Months in both."""
    return a[0].bitwiseAND(b[0]), a[1].bitwiseAND(b[1])


def how_many(months: tuple[Column, Column]) -> Column:
    """Number of months."""
    return F.bit_count(months[0]) + F.bit_count(months[1])


def runs_of(late: tuple[Column, Column], other: tuple[Column, Column]) -> Column:
    """Runs of the late months in the order of the rows, where only another month, not a gap, ends a run.

    Every month that is not another one is filled; adding the late months to the filled ones carries into the
    month behind a stretch exactly when the stretch holds a late month.
    """
    width = P.PANEL_MONTHS[1] - P.PANEL_MONTHS[0] + 1 - WORD
    low = F.lit(2**WORD - 1) - other[0] + late[0]
    high = F.lit(2**width - 1) - other[1] + late[1] + F.call_function("shiftright", low, F.lit(WORD))
    return how_many((low.bitwiseAND(other[0]), high.bitwiseAND(other[1].bitwiseOR(F.lit(2**width)))))


def roll_rates(panel: DataFrame) -> DataFrame:
    """Share of each next state after each reported state, consecutive months only."""
    credits = state_months(clean_panel(panel), {f"s{s}": (s,) for s in PANEL_STATES})
    moves = [(s, t) for s in PANEL_STATES[FIRST_REPORTED:] for t in PANEL_STATES]
    sums = credits.agg(*[F.sum(how_many(both(months_of(f"s{s}"), month_before(months_of(f"s{t}"))))).alias(f"{s}{t}") for s, t in moves])
    cells = F.array(*[F.struct(F.lit(s).alias(STATUS), F.lit(t).alias("next_status"), F.col(f"{s}{t}").alias("n")) for s, t in moves])
    counts = sums.select(F.explode(cells).alias("x")).select("x.*").filter("n > 0")
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(STATUS)))


def arrears_path(panel: DataFrame) -> DataFrame:
    """Per credit: arrears episodes, whether level 1 escalated or cured, months to the first arrears."""
    late = F.min(F.when(F.col(IS_ARREARS) == 1, F.col(MONTH)))
    sets = {"one": ("1",), "worse": ("2", "3", "4", "5"), "well": ("0", "C"), "blind": ("X",)}
    credits = state_months(clean_panel(panel), sets, {"months_to_first_arrears": late - F.min(MONTH)})

    def followed(*names: str) -> Column:
        return (how_many(both(months_of("one"), month_before(months_of(*names)))) > 0).cast("int")

    return credits.select(
        CREDIT,
        runs_of(months_of("one", "worse"), months_of("well", "blind")).cast("bigint").alias("episodes"),
        followed(*sets).alias("passed_level_1"),
        followed("worse").alias("escalated"),
        followed("well").alias("cured"),
        "months_to_first_arrears",
    )


def last_state(panel: DataFrame) -> DataFrame:
    """Last observed state of each credit, without sorting."""
    last = panel.groupBy(CREDIT).agg(F.max(packed_state()).alias("_p"), F.max(MONTH).alias("last_month"))
    return last.select(CREDIT, unpacked_state(F.col("_p")).alias("last_status"), "last_month")

