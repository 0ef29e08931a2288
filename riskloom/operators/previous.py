"""Previous applications per client."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions.nullsafe import (
    any_of,
    as_double,
    count_of,
    differs,
    flag_where,
    holds,
    mean_of,
    require_columns,
    share_where,
)
from riskloom.operators.cleaning import clean_previous
from riskloom.operators.features import combination_defined, grant_ratio, is_recent, purpose_declared
from riskloom.operators.history import resolve_cuts

CLIENT = "SK_ID_CURR"
NUMBERS = (
    "DAYS_DECISION",
    "CNT_PAYMENT",
    "AMT_APPLICATION",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "RATE_DOWN_PAYMENT",
    "DAYS_LAST_DUE_1ST_VERSION",
    "DAYS_LAST_DUE",
    "HOUR_APPR_PROCESS_START",
)
TEXTS = (
    "NAME_CLIENT_TYPE",
    "NAME_CONTRACT_STATUS",
    "NAME_CONTRACT_TYPE",
    "CODE_REJECT_REASON",
    "PRODUCT_COMBINATION",
    "NAME_TYPE_SUITE",
    "NAME_CASH_LOAN_PURPOSE",
)
DEFAULT_CUTS = {
    "prev_ventana_reciente_dias": P.RECENT_WINDOW_DAYS,
    "suelo_anios_denominador": P.MIN_YEARS,
    "prev_plazo_largo_cuotas": P.LONG_TERM_INSTALMENTS,
    "prev_adelanto_liquidacion_dias": P.EARLY_SETTLEMENT_DAYS,
    "prev_hora_temprana_max": P.EARLY_HOUR_MAX,
    "prev_relacion_larga_anios": P.LONG_RELATION_YEARS,
}
CUTS = (
    *DEFAULT_CUTS,
    "prev_sobreconcesion_corte",
    "prev_finalidades_urgentes",
    "prev_count_cola",
    "prev_actividad_12m_cola",
)
RETURNING = ("Repeater", "Refreshed")
STREET = "Street"
PREVIOUS_FLAGS = (
    "PREV_HISTORIAL_RECORTADO",
    "PREV_REFUSED_SCOFR_FLAG",
    "PREV_REFUSED_LONG_TERM_FLAG",
    "PREV_EARLY_SETTLED_FLAG",
    "PREV_PHANTOM_FLAG",
    "PREV_COUNT_COLA",
    "PREV_ACTIVIDAD_12M_COLA",
    "PREV_RELACION_CORTA_ACTIVA",
)


def populations() -> dict[str, Column | None]:
    """Named populations over the joined client frame; None is the one of the measure itself."""
    return {
        "global": None,
        "no nulos (auto-cond.)": None,
        "con previas": F.col("HAS_PREV_APPLICATION") == 1,
        "con algún rechazo": F.col("PREV_REFUSED_COUNT") > 0,
        "con operación terminada": F.col("PREV_EARLY_SETTLED_FLAG").isNotNull(),
        "con finalidad informada": F.col("PREV_URGENT_PURPOSE_RATIO").isNotNull(),
    }


def _with_client_days(prev: DataFrame, **ends: Column) -> DataFrame:
    """Rows with aggregates of their client. The rows are not gathered by client: the aggregates are joined back."""
    per_client = prev.groupBy(F.col(CLIENT).alias("_client")).agg(*[e.alias(n) for n, e in ends.items()])
    return prev.join(per_client, F.col(CLIENT).eqNullSafe(F.col("_client")), "left").drop("_client")


def with_window_end(prev: DataFrame, name: str = "window_end") -> DataFrame:
    """Latest decision of the client, repeated on each of its rows."""
    return _with_client_days(prev, **{name: F.max("DAYS_DECISION")})


def oldest_rows(prev: DataFrame) -> DataFrame:
    """Mark the rows decided on the client's oldest day; ties all count."""
    marked = _with_client_days(prev, _first=F.min("DAYS_DECISION"))
    return marked.withColumn("is_oldest", holds(F.col("DAYS_DECISION") == F.col("_first")).cast("int")).drop("_first")


def from_street() -> Column:
    """Whether the product combination names the street channel."""
    return F.col("PRODUCT_COMBINATION").contains(STREET)


def truncated_history() -> Column:
    """Any row of the oldest day from a returning client, in one hash aggregate and without a window.

    Days are whole, or the aggregate fails; so twice the age plus the returning bit orders by age first, and the
    maximum belongs to the oldest day and is odd as soon as one row of that day is returning.
    """
    day = F.col("DAYS_DECISION")
    whole = F.when(day != F.floor(day), F.raise_error(F.lit("DAYS_DECISION holds a fraction of a day")).cast("double")).otherwise(day)
    back = holds(F.col("NAME_CLIENT_TYPE").isin(*RETURNING)).cast("int")
    top = F.max(-whole * 2 + back)
    return F.coalesce(F.pmod(top, F.lit(2)).cast("int"), F.lit(0))


def previous_aggregates(c: Mapping) -> dict[str, Column]:
    """Column -> aggregate over cleaned application rows."""
    state = F.col("NAME_CONTRACT_STATUS")
    refused, approved = state == "Refused", state == "Approved"
    grant = grant_ratio()
    annuity, term, credit = F.col("AMT_ANNUITY"), F.col("CNT_PAYMENT"), F.col("AMT_CREDIT")
    payable = approved & (annuity > 0) & (term > 0) & (credit > 0)
    planned = F.col("DAYS_LAST_DUE_1ST_VERSION")
    ahead = planned - F.col("DAYS_LAST_DUE")
    recent = is_recent(c["prev_ventana_reciente_dias"])
    count, recent_count = F.count(F.lit(1)), count_of(recent)
    years = -F.min("DAYS_DECISION") / P.DAYS_PER_YEAR
    busy = recent_count >= c["prev_actividad_12m_cola"]
    urgent = F.col("NAME_CASH_LOAN_PURPOSE").isin(*c["prev_finalidades_urgentes"])
    return {
        "PREV_APPLICATION_COUNT": count,
        "PREV_DAYS_DECISION_MIN": F.min("DAYS_DECISION"),
        "PREV_DAYS_DECISION_MAX": F.max("DAYS_DECISION"),
        "PREV_COUNT_12M": recent_count,
        "PREV_HISTORIAL_RECORTADO": truncated_history(),
        "PREV_REFUSED_COUNT": count_of(refused),
        "PREV_REFUSED_RATIO": mean_of(refused),
        "PREV_REFUSED_SCOFR_FLAG": any_of(refused & (F.col("CODE_REJECT_REASON") == "SCOFR")),
        "PREV_REFUSED_LONG_TERM_FLAG": any_of(
            (term > c["prev_plazo_largo_cuotas"]) & differs("NAME_CONTRACT_STATUS", "Approved")
        ),
        "PREV_CREDIT_APPLICATION_RATIO": F.avg(grant),
        "PREV_OVERGRANTED_RATIO": share_where(grant > c["prev_sobreconcesion_corte"], grant.isNotNull()),
        "PREV_CNT_PAYMENT_MEAN": F.avg(F.when(term > 0, term)),
        "PREV_IMPLIED_COST_MEAN": F.avg(F.when(payable, F.try_divide(annuity * term, credit))),
        "PREV_DOWN_PAYMENT_RATE_MEAN": F.avg(
            F.when(F.col("NAME_CONTRACT_TYPE") == "Consumer loans", F.col("RATE_DOWN_PAYMENT"))
        ),
        "PREV_EARLY_SETTLED_FLAG": F.max(
            flag_where(ahead > c["prev_adelanto_liquidacion_dias"], ahead.isNotNull())
        ),
        "PREV_FUTURE_DUE_MAX": F.max(F.when(planned > 0, planned)),
        "PREV_STREET_RATIO": share_where(from_street(), combination_defined()),
        "PREV_EARLY_HOUR_RATIO": mean_of(F.col("HOUR_APPR_PROCESS_START") <= c["prev_hora_temprana_max"]),
        "PREV_NO_SUITE_RATIO": mean_of(F.col("NAME_TYPE_SUITE").isNull()),
        "PREV_URGENT_PURPOSE_RATIO": share_where(urgent, purpose_declared()),
        "PREV_PHANTOM_FLAG": any_of(~combination_defined()),
        "PREV_APPLICATIONS_PER_YEAR": count / F.greatest(years, F.lit(float(c["suelo_anios_denominador"]))),
        "PREV_COUNT_COLA": (count >= c["prev_count_cola"]).cast("int"),
        "PREV_ACTIVIDAD_12M_COLA": busy.cast("int"),
        "PREV_RELACION_CORTA_ACTIVA": holds(busy & (years < c["prev_relacion_larga_anios"])).cast("int"),
    }


def cleaned(prev: DataFrame) -> DataFrame:
    """Cleaned rows with a client, numbers as doubles."""
    return clean_previous(as_double(prev, [c for c in NUMBERS if c in prev.columns])).filter(F.col(CLIENT).isNotNull())


def aggregate_previous(prev: DataFrame, cuts: Mapping | None = None) -> DataFrame:
    """One row per client with previous applications, from raw or cleaned rows."""
    require_columns(prev, (CLIENT, *TEXTS, *NUMBERS), "previous applications")
    c = resolve_cuts(cuts, DEFAULT_CUTS, CUTS, CUTS, "previous applications")
    return cleaned(prev).groupBy(CLIENT).agg(*[e.alias(n) for n, e in previous_aggregates(c).items()])


def live_only_end(prev: DataFrame) -> DataFrame:
    """Planned end of the operations that have not ended."""
    planned = F.col("DAYS_LAST_DUE_1ST_VERSION")
    live = F.when((planned > 0) & F.col("DAYS_LAST_DUE").isNull(), planned)
    return cleaned(prev).groupBy(CLIENT).agg(F.max(live).alias("PREV_FUTURE_DUE_VIVAS"))


def denominator_counts(prev: DataFrame) -> DataFrame:
    """Rows behind each proportion, per client."""
    everything = F.count(F.lit(1))
    return cleaned(prev).groupBy(CLIENT).agg(
        everything.alias("PREV_REFUSED_RATIO"),
        F.count(grant_ratio()).alias("PREV_OVERGRANTED_RATIO"),
        count_of(combination_defined()).alias("PREV_STREET_RATIO"),
        everything.alias("PREV_NO_SUITE_RATIO"),
        everything.alias("PREV_EARLY_HOUR_RATIO"),
        count_of(purpose_declared()).alias("PREV_URGENT_PURPOSE_RATIO"),
    )


def relative_recency(
    prev: DataFrame, window: float = P.RECENT_WINDOW_DAYS, hour_max: float = P.EARLY_HOUR_MAX, relative: bool = True
) -> DataFrame:
    """Six recency readings per client, counted back from the client's own last application.

    Rows are first summed up by (client, day), with map-side partial sums; what meets per client is one row per
    distinct day, however busy the client.
    """
    refused, days = F.col("NAME_CONTRACT_STATUS") == "Refused", F.col("DAYS_DECISION")
    parts = {
        "STREET": flag_where(from_street(), combination_defined()),
        "EARLY_HOUR": holds(F.col("HOUR_APPR_PROCESS_START") <= hour_max).cast("double"),
        "NO_SUITE": F.col("NAME_TYPE_SUITE").isNull().cast("double"),
    }
    by_day = cleaned(prev).groupBy(CLIENT, "DAYS_DECISION").agg(
        F.count(F.lit(1)).alias("_n"),
        any_of(refused).alias("_refused"),
        *[F.sum(e.cast("double")).alias(f"_s_{n}") for n, e in parts.items()],
        *[F.count(e).alias(f"_c_{n}") for n, e in parts.items()],
    )
    by_day = by_day.withColumn("_end", F.max("DAYS_DECISION").over(Window.partitionBy(CLIENT)))
    end, hit = F.col("_end"), F.col("_refused") > 0
    recent = is_recent(window, end if relative else None)

    def mean_recent(name: str) -> Column:
        total, count = (F.sum(F.when(recent, F.col(f"_{k}_{name}"))) for k in ("s", "c"))
        return F.try_divide(total, count)

    return by_day.groupBy(CLIENT).agg(
        F.max(holds(hit & (days == end)).cast("double")).alias("PREV_EXIT_REFUSED_FLAG"),
        F.max(F.when(hit, days - end)).alias("PREV_DAYS_SINCE_REFUSED_REL"),
        F.coalesce(F.sum(F.when(recent, F.col("_n"))), F.lit(0)).cast("double").alias("PREV_COUNT_12M_REL"),
        *[mean_recent(n).alias(f"PREV_{n}_RATIO_REL") for n in parts],
    )
