"""Credit history per client: one hash aggregate over flags computed in the same stage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions.nullsafe import (
    any_of,
    as_double,
    count_of,
    holds,
    mean_of,
    ratio,
    require_columns,
    require_known,
)
from riskloom.operators.cleaning import FOREIGN_FLAG, HISTORY_AMOUNTS, SIGN_SUFFIX, clean_history
from riskloom.operators.features import CARD, term_end_date

CLIENT = "SK_ID_CURR"
TEXTS = ("CREDIT_ACTIVE", "CREDIT_TYPE", "CREDIT_CURRENCY")
NUMBERS = (
    "DAYS_CREDIT",
    "CREDIT_DAY_OVERDUE",
    "DAYS_CREDIT_ENDDATE",
    "DAYS_ENDDATE_FACT",
    "DAYS_CREDIT_UPDATE",
    "CNT_CREDIT_PROLONG",
    *HISTORY_AMOUNTS,
)
DEFAULT_CUTS = {
    "suelo_anios_denominador": P.MIN_YEARS,
    "bureau_update_reciente_dias": P.RECENT_UPDATE_DAYS,
}
CUTS = (
    *DEFAULT_CUTS,
    "bureau_enddate_tramo_min_anios",
    "bureau_enddate_tramo_max_anios",
    "bureau_count_cola",
)


def populations() -> dict[str, Column | None]:
    """Named populations over the joined client frame; None is the one of the measure itself."""
    return {
        "global (nulo=0)": None,
        "no nulos (auto-cond.)": None,
        "con historial": F.col("HAS_BUREAU_HISTORY") == 1,
        "con créditos cerrados": F.col("BUREAU_CLOSED_COUNT") > 0,
        "solo con cuota": F.col("BUREAU_CREDITS_WITH_ANNUITY_COUNT") > 0,
    }


def resolve_cuts(cuts: Mapping | None, defaults: Mapping, known: tuple, needed: tuple, what: str) -> dict:
    """Given cuts over the fixed ones; an unknown name or a cut nobody fitted fails by name."""
    cuts = dict(cuts or {})
    require_known(cuts, known, what)
    merged = {**defaults, **cuts}
    unset = [n for n in needed if merged.get(n) is None]
    if unset:
        raise ValueError(f"{what}: cut-points not fitted {unset}")
    return {n: merged[n] for n in needed}


def history_aggregates(c: Mapping[str, float]) -> dict[str, Column]:
    """Column -> aggregate over cleaned history rows."""
    status, kind = F.col("CREDIT_ACTIVE"), F.col("CREDIT_TYPE")
    active, closed = status == "Active", status == "Closed"

    def sign(amount: str) -> Column:
        return F.col(amount + SIGN_SUFFIX)

    late_ever = sign("AMT_CREDIT_MAX_OVERDUE") > 0
    late_now = sign("AMT_CREDIT_SUM_OVERDUE") > 0
    has_annuity = sign("AMT_ANNUITY") > 0
    term = term_end_date()
    day = P.DAYS_PER_YEAR
    years = F.greatest(-F.min("DAYS_CREDIT") / day, F.lit(float(c["suelo_anios_denominador"])))
    last_update = F.max("DAYS_CREDIT_UPDATE")
    count = F.count(F.lit(1))
    return {
        "BUREAU_LOAN_COUNT": count,
        "BUREAU_ACTIVE_COUNT": count_of(active),
        "BUREAU_CLOSED_COUNT": count_of(closed),
        "BUREAU_BAD_DEBT_COUNT": count_of(status.isin("Sold", "Bad debt")),
        "BUREAU_CREDIT_TYPE_NUNIQUE": F.size(F.collect_set(kind)).cast("bigint"),  # bounded by the credit types, and one exchange fewer
        "BUREAU_MAX_OVERDUE_EVER": F.max("AMT_CREDIT_MAX_OVERDUE"),
        "BUREAU_HAS_ANY_OVERDUE": any_of(late_ever),
        "BUREAU_HAS_CURRENT_OVERDUE": any_of(late_now),
        "BUREAU_NEGATIVE_LIMIT_FLAG": any_of(sign("AMT_CREDIT_SUM_LIMIT") < 0),
        "BUREAU_CREDITS_WITH_ANNUITY_COUNT": count_of(has_annuity),
        "BUREAU_ANNUITY_ACTIVE_RATIO": mean_of(has_annuity),
        "BUREAU_DAYS_CREDIT_MIN": F.min("DAYS_CREDIT"),
        "BUREAU_DAYS_CREDIT_MAX": F.max("DAYS_CREDIT"),
        "BUREAU_CLOSED_AFTER_ENDDATE": count_of(closed & (F.col("DAYS_ENDDATE_FACT") > F.col("DAYS_CREDIT_ENDDATE"))),
        "HAS_BUREAU_FINANCIAL_DETAIL": any_of(
            sign("AMT_CREDIT_SUM_LIMIT").isNotNull() | sign("AMT_CREDIT_SUM_DEBT").isNotNull()
        ),
        "HAS_BUREAU_OVERDUE_HISTORY": any_of(sign("AMT_CREDIT_MAX_OVERDUE").isNotNull()),
        "HAS_BUREAU_ANNUITY": any_of(sign("AMT_ANNUITY").isNotNull()),
        "BUREAU_ACTIVE_CARD_COUNT": count_of(active & (kind == CARD)),
        "BUREAU_ACTIVE_CONSUMER_COUNT": count_of(active & (kind == "Consumer credit")),
        "BUREAU_ENDDATE_2_5Y_COUNT": count_of(
            (term > c["bureau_enddate_tramo_min_anios"] * day) & (term <= c["bureau_enddate_tramo_max_anios"] * day)
        ),
        "BUREAU_DAYS_CREDIT_ENDDATE_MAX": F.max(term),
        "BUREAU_OVERDUE_UNION": any_of(holds(late_ever) | holds(late_now) | holds(F.col("CREDIT_DAY_OVERDUE") > 0)),
        "BUREAU_HAS_FOREIGN_CURRENCY": F.max(FOREIGN_FLAG),
        "BUREAU_CURRENT_OVERDUE_SUM": F.sum("AMT_CREDIT_SUM_OVERDUE"),
        "BUREAU_DEBT_CREDIT_RATIO": ratio(F.sum("AMT_CREDIT_SUM_DEBT"), F.sum("AMT_CREDIT_SUM")),
        "BUREAU_CREDITS_PER_YEAR": count / years,
        "HAS_BEEN_PROLONGED": F.coalesce(F.max("CNT_CREDIT_PROLONG") > 0, F.lit(False)).cast("int"),
        "BUREAU_COUNT_COLA": (count >= c["bureau_count_cola"]).cast("int"),
        "BUREAU_DAYS_CREDIT_UPDATE_FLAG": (last_update > -c["bureau_update_reciente_dias"]).cast("double"),
    }


# the columns of the aggregate that are yes/no questions
HISTORY_FLAGS = (
    "BUREAU_HAS_ANY_OVERDUE",
    "BUREAU_HAS_CURRENT_OVERDUE",
    "BUREAU_NEGATIVE_LIMIT_FLAG",
    "HAS_BUREAU_FINANCIAL_DETAIL",
    "HAS_BUREAU_OVERDUE_HISTORY",
    "HAS_BUREAU_ANNUITY",
    "BUREAU_OVERDUE_UNION",
    "BUREAU_HAS_FOREIGN_CURRENCY",
    "HAS_BEEN_PROLONGED",
    "BUREAU_COUNT_COLA",
    "BUREAU_DAYS_CREDIT_UPDATE_FLAG",
)


def aggregate_history(history: DataFrame, cuts: Mapping[str, float] | None = None) -> DataFrame:
    """One row per client with credit history, from raw or cleaned rows."""
    require_columns(history, (CLIENT, *TEXTS, *NUMBERS), "credit history")
    c = resolve_cuts(cuts, DEFAULT_CUTS, CUTS, CUTS, "credit history")
    rows = clean_history(as_double(history, NUMBERS)).filter(F.col(CLIENT).isNotNull())
    return rows.groupBy(CLIENT).agg(*[e.alias(n) for n, e in history_aggregates(c).items()])
