"""Shared pieces of the queries: cleaned tables, aggregates and the joined clients, on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators import cleaning as C
from riskloom.operators.features import BUILDING, layer_one
from riskloom.operators.history import aggregate_history
from riskloom.operators.joins import join_history, join_panel, join_previous
from riskloom.operators.panel import aggregate_panel, credit_bridge
from riskloom.operators.previous import aggregate_previous
from riskloom.queries import standin as S
from riskloom.queries.registry import cte

# cut-points used by the queries that do not fit them
CUTS = {
    "bureau_enddate_tramo_min_anios": 2.0,
    "bureau_enddate_tramo_max_anios": 5.0,
    "bureau_count_cola": 12,
    "bb_many_credits_corte": 11,
    "prev_count_cola": 6,
    "prev_actividad_12m_cola": 2,
    "prev_sobreconcesion_corte": 1.2,
    "prev_finalidades_urgentes": ("Car repairs", "Medicine"),
}
H_CUTS = {k: v for k, v in CUTS.items() if k.startswith("bureau_")}
B_CUTS = {k: v for k, v in CUTS.items() if k.startswith("bb_")}
P_CUTS = {k: v for k, v in CUTS.items() if k.startswith("prev_")}


def app(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    """Cleaned training population with layer 1."""
    return layer_one(C.clean_training_application(S.application(spark, sf, spread)))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    """(client, target) of the training population."""
    return app(spark, sf).select("SK_ID_CURR", "TARGET")


def hist(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned credit history."""
    return C.clean_history(S.history(spark, sf))


def hist_t(spark: SparkSession, sf: str) -> DataFrame:
    """Raw credit history of labelled clients."""
    return S.history(spark, sf).join(labels(spark, sf), "SK_ID_CURR")


def clients(spark: SparkSession, sf: str, with_: str = "hbp") -> DataFrame:
    """Population joined with its history (h), panel (b) and previous (p) aggregates."""
    df = app(spark, sf)
    if "h" in with_:
        df = join_history(df, aggregate_history(S.history(spark, sf), H_CUTS))
    if "b" in with_:
        df = join_panel(df, aggregate_panel(S.panel(spark, sf), credit_bridge(S.history(spark, sf)), B_CUTS))
    if "p" in with_:
        df = join_previous(df, aggregate_previous(S.previous(spark, sf), P_CUTS))
    return df


# -- DuckDB pieces -----------------------------------------------------------------------------

for _name, _sql in S.ctes().items():
    cte(_name, _sql)

RESIDUAL = (
    "(CODE_GENDER IS NOT NULL AND CODE_GENDER = 'XNA') OR (NAME_FAMILY_STATUS IS NOT NULL AND NAME_FAMILY_STATUS = 'Unknown') "
    "OR CNT_FAM_MEMBERS IS NULL OR DAYS_LAST_PHONE_CHANGE IS NULL OR AMT_ANNUITY IS NULL"
)
CLEAN_APP = (
    "SELECT * EXCLUDE (FLAG_MOBIL, FLAG_EMP_PHONE, OBS_60_CNT_SOCIAL_CIRCLE, APARTMENTS_MODE, APARTMENTS_MEDI) REPLACE ("
    "nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED, "
    "CASE WHEN AMT_REQ_CREDIT_BUREAU_DAY > 5 THEN 5 ELSE AMT_REQ_CREDIT_BUREAU_DAY END AS AMT_REQ_CREDIT_BUREAU_DAY), "
    "CASE WHEN DAYS_EMPLOYED = 365243 THEN 1 ELSE 0 END AS FLAG_DAYS_EMPLOYED_ANOMALY FROM app_raw"
)
cte("app_score", CLEAN_APP)
cte("app_clean", f"{CLEAN_APP} WHERE NOT ({RESIDUAL})")
_BUILD = " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in BUILDING)
_REQ = " AND ".join(f"AMT_REQ_CREDIT_BUREAU_{w} IS NOT NULL" for w in ("HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR"))
cte(
    "app1",
    f"SELECT *, {_BUILD} AS BUILDING_INFO_COUNT, CASE WHEN {_BUILD} > 0 THEN 1 ELSE 0 END AS HAS_BUILDING_INFO, "
    f"CASE WHEN {_REQ} THEN 1 ELSE 0 END AS HAS_BUREAU_INFO, "
    "CASE WHEN OBS_30_CNT_SOCIAL_CIRCLE IS NOT NULL AND DEF_30_CNT_SOCIAL_CIRCLE IS NOT NULL THEN 1 ELSE 0 END AS HAS_SOCIAL_INFO, "
    "CASE WHEN EXT_SOURCE_1 IS NULL THEN 1 ELSE 0 END AS FLAG_EXT_SOURCE_1_NULL, CASE WHEN EXT_SOURCE_3 IS NULL THEN 1 ELSE 0 END AS FLAG_EXT_SOURCE_3_NULL, "
    "-DAYS_BIRTH / 365.25 AS AGE_YEARS, DAYS_EMPLOYED / nullif(DAYS_BIRTH, 0) AS EMPLOYED_TO_AGE_RATIO, AMT_CREDIT / nullif(AMT_GOODS_PRICE, 0) AS LTV FROM app_clean",
)
_SIGNED = [c for c in C.HISTORY_AMOUNTS if c != "AMT_CREDIT_SUM"]
cte(
    "hist1",
    "SELECT * REPLACE ("
    + ", ".join(f"CASE WHEN CREDIT_CURRENCY = 'currency 1' THEN {c} END AS {c}" for c in C.HISTORY_AMOUNTS)
    + "), "
    + ", ".join(f"sign({c}) AS {c}_SIGNO" for c in _SIGNED)
    + ", CASE WHEN CREDIT_CURRENCY = 'currency 1' THEN 0 ELSE 1 END AS BUREAU_FOREIGN_CURRENCY FROM hist_raw",
)
cte(
    "hist2",
    "SELECT * REPLACE ("
    + ", ".join(f"CASE WHEN {c} > {k} THEN NULL ELSE {c} END AS {c}" for c, k in C.AMOUNT_CAPS.items())
    + ") FROM hist1",
)
cte(
    "hist_clean",
    "SELECT * REPLACE (CASE WHEN AMT_CREDIT_SUM > 0 AND AMT_CREDIT_SUM_DEBT / nullif(AMT_CREDIT_SUM, 0) > 3 THEN AMT_CREDIT_SUM ELSE AMT_CREDIT_SUM_DEBT END AS AMT_CREDIT_SUM_DEBT, "
    "CASE WHEN DAYS_CREDIT_ENDDATE < -10957.5 OR DAYS_CREDIT_ENDDATE > 7305 THEN NULL ELSE DAYS_CREDIT_ENDDATE END AS DAYS_CREDIT_ENDDATE, "
    "CASE WHEN DAYS_ENDDATE_FACT < -10957.5 THEN NULL ELSE DAYS_ENDDATE_FACT END AS DAYS_ENDDATE_FACT, "
    "CASE WHEN DAYS_CREDIT_UPDATE < -10957.5 THEN NULL ELSE DAYS_CREDIT_UPDATE END AS DAYS_CREDIT_UPDATE) FROM hist2",
)
_TERM = "CASE WHEN CREDIT_TYPE IS DISTINCT FROM 'Credit card' THEN DAYS_CREDIT_ENDDATE END"


def n_if(cond: str) -> str:
    """Count of rows where a condition is true."""
    return f"count(*) FILTER (WHERE {cond})"


def any_if(cond: str) -> str:
    """1 when the condition is true on some row."""
    return f"CASE WHEN {n_if(cond)} > 0 THEN 1 ELSE 0 END"


cte(
    "agg_h",
    f"""SELECT SK_ID_CURR, count(*) AS BUREAU_LOAN_COUNT, {n_if("CREDIT_ACTIVE = 'Active'")} AS BUREAU_ACTIVE_COUNT,
{n_if("CREDIT_ACTIVE = 'Closed'")} AS BUREAU_CLOSED_COUNT, {n_if("CREDIT_ACTIVE IN ('Sold', 'Bad debt')")} AS BUREAU_BAD_DEBT_COUNT,
count(DISTINCT CREDIT_TYPE) AS BUREAU_CREDIT_TYPE_NUNIQUE, max(AMT_CREDIT_MAX_OVERDUE) AS BUREAU_MAX_OVERDUE_EVER,
{any_if("AMT_CREDIT_MAX_OVERDUE_SIGNO > 0")} AS BUREAU_HAS_ANY_OVERDUE, {any_if("AMT_CREDIT_SUM_OVERDUE_SIGNO > 0")} AS BUREAU_HAS_CURRENT_OVERDUE,
{any_if("AMT_CREDIT_SUM_LIMIT_SIGNO < 0")} AS BUREAU_NEGATIVE_LIMIT_FLAG, {n_if("AMT_ANNUITY_SIGNO > 0")} AS BUREAU_CREDITS_WITH_ANNUITY_COUNT,
{n_if("AMT_ANNUITY_SIGNO > 0")} / count(*) AS BUREAU_ANNUITY_ACTIVE_RATIO, min(DAYS_CREDIT) AS BUREAU_DAYS_CREDIT_MIN, max(DAYS_CREDIT) AS BUREAU_DAYS_CREDIT_MAX,
{n_if("CREDIT_ACTIVE = 'Closed' AND DAYS_ENDDATE_FACT > DAYS_CREDIT_ENDDATE")} AS BUREAU_CLOSED_AFTER_ENDDATE,
{any_if("AMT_CREDIT_SUM_LIMIT_SIGNO IS NOT NULL OR AMT_CREDIT_SUM_DEBT_SIGNO IS NOT NULL")} AS HAS_BUREAU_FINANCIAL_DETAIL,
{any_if("AMT_CREDIT_MAX_OVERDUE_SIGNO IS NOT NULL")} AS HAS_BUREAU_OVERDUE_HISTORY, {any_if("AMT_ANNUITY_SIGNO IS NOT NULL")} AS HAS_BUREAU_ANNUITY,
{n_if("CREDIT_ACTIVE = 'Active' AND CREDIT_TYPE = 'Credit card'")} AS BUREAU_ACTIVE_CARD_COUNT,
{n_if("CREDIT_ACTIVE = 'Active' AND CREDIT_TYPE = 'Consumer credit'")} AS BUREAU_ACTIVE_CONSUMER_COUNT,
{n_if(f"({_TERM}) > 2.0 * 365.25 AND ({_TERM}) <= 5.0 * 365.25")} AS BUREAU_ENDDATE_2_5Y_COUNT, max({_TERM}) AS BUREAU_DAYS_CREDIT_ENDDATE_MAX,
{any_if("AMT_CREDIT_MAX_OVERDUE_SIGNO > 0 OR AMT_CREDIT_SUM_OVERDUE_SIGNO > 0 OR CREDIT_DAY_OVERDUE > 0")} AS BUREAU_OVERDUE_UNION,
max(BUREAU_FOREIGN_CURRENCY) AS BUREAU_HAS_FOREIGN_CURRENCY, sum(AMT_CREDIT_SUM_OVERDUE) AS BUREAU_CURRENT_OVERDUE_SUM,
sum(AMT_CREDIT_SUM_DEBT) / nullif(sum(AMT_CREDIT_SUM), 0) AS BUREAU_DEBT_CREDIT_RATIO,
count(*) / greatest(-min(DAYS_CREDIT) / 365.25, 0.5) AS BUREAU_CREDITS_PER_YEAR,
CASE WHEN max(CNT_CREDIT_PROLONG) > 0 THEN 1 ELSE 0 END AS HAS_BEEN_PROLONGED, CASE WHEN count(*) >= 12 THEN 1 ELSE 0 END AS BUREAU_COUNT_COLA,
CASE WHEN max(DAYS_CREDIT_UPDATE) IS NULL THEN NULL WHEN max(DAYS_CREDIT_UPDATE) > -180 THEN 1 ELSE 0 END AS BUREAU_DAYS_CREDIT_UPDATE_FLAG
FROM hist_clean GROUP BY 1""",
)
cte(
    "panel_clean",
    "SELECT SK_ID_BUREAU, MONTHS_BALANCE, upper(trim(STATUS)) AS STATUS, TRY_CAST(upper(trim(STATUS)) AS DOUBLE) AS BB_DPD, "
    "CASE WHEN upper(trim(STATUS)) = 'X' THEN 1 ELSE 0 END AS BB_IS_X, CASE WHEN TRY_CAST(upper(trim(STATUS)) AS DOUBLE) > 0 THEN 1 ELSE 0 END AS BB_IS_DPD FROM panel_raw",
)
cte(
    "panel_halves",
    "SELECT *, MONTHS_BALANCE - min(MONTHS_BALANCE) OVER w > max(MONTHS_BALANCE) OVER w - MONTHS_BALANCE AS is_recent FROM panel_clean WINDOW w AS (PARTITION BY SK_ID_BUREAU)",
)
cte(
    "agg_c0",
    """SELECT SK_ID_BUREAU, count(*) AS BB_MONTHS_OBS, count(BB_DPD) AS BB_MONTHS_REPORTED, max(BB_DPD) AS BB_WORST, avg(BB_IS_X) AS BB_PCT_X,
min(MONTHS_BALANCE) AS BB_WINDOW_INI, max(MONTHS_BALANCE) AS BB_WINDOW_END, CASE WHEN count(BB_DPD) > 0 THEN sum(BB_IS_DPD) END AS BB_DPD_MONTHS,
arg_max(STATUS, MONTHS_BALANCE) AS BB_LAST_STATUS, max(MONTHS_BALANCE) FILTER (WHERE BB_IS_DPD = 1) AS BB_LAST_DPD_MONTH,
max(BB_DPD) FILTER (WHERE NOT is_recent) AS BB_WORST_OLD_HALF, max(BB_DPD) FILTER (WHERE is_recent) AS BB_WORST_RECENT_HALF FROM panel_halves GROUP BY 1""",
)
cte(
    "agg_c",
    """SELECT *, BB_DPD_MONTHS / nullif(BB_MONTHS_REPORTED, 0) AS BB_PCT_DPD, CASE WHEN BB_WINDOW_END < 0 THEN 1 ELSE 0 END AS BB_CENSORED,
CASE WHEN BB_MONTHS_OBS < 6 OR BB_WORST_OLD_HALF IS NULL OR BB_WORST_RECENT_HALF IS NULL THEN NULL WHEN BB_WORST_OLD_HALF = 0 AND BB_WORST_RECENT_HALF = 0 THEN 0
WHEN BB_WORST_RECENT_HALF < BB_WORST_OLD_HALF THEN 1 WHEN BB_WORST_RECENT_HALF > BB_WORST_OLD_HALF THEN 2 ELSE 3 END AS BB_CREDIT_TRAJECTORY FROM agg_c0""",
)
cte("bridge", "SELECT SK_ID_BUREAU, SK_ID_CURR FROM hist_raw")
cte(
    "agg_b",
    f"""SELECT SK_ID_CURR, count(*) AS BB_N_CREDITS_WBAL, sum(BB_MONTHS_OBS) AS BB_MONTHS_TOTAL, sum(BB_MONTHS_REPORTED) AS BB_MONTHS_REPORTED, max(BB_WORST) AS BB_STATUS_WORST,
{any_if("BB_DPD_MONTHS > 0")} AS BB_ANY_DPD_FLAG, {any_if("BB_LAST_DPD_MONTH >= -6")} AS BB_RECENT_DPD_FLAG, {any_if("BB_WORST = 5")} AS BB_WRITEOFF_FLAG,
max(BB_LAST_DPD_MONTH) AS BB_MONTHS_SINCE_LAST_DPD, avg(BB_CENSORED) AS BB_CENSORED_RATIO, max(BB_LAST_DPD_MONTH - BB_WINDOW_END) AS BB_MONTHS_SINCE_LAST_DPD_REL,
{any_if("BB_LAST_STATUS IN ('1', '2', '3', '4', '5')")} AS BB_EXITS_IN_DPD_FLAG, CASE WHEN {n_if("BB_LAST_STATUS = 'C'")} = count(*) THEN 1 ELSE 0 END AS BB_ALL_CLOSED_FLAG,
CASE max(BB_CREDIT_TRAJECTORY) WHEN 0 THEN 'sin mora' WHEN 1 THEN 'mejora' WHEN 2 THEN 'empeora' WHEN 3 THEN 'estable' END AS BB_TRAJECTORY,
sum(CASE WHEN BB_DPD_MONTHS > 0 THEN 1 WHEN BB_DPD_MONTHS IS NOT NULL THEN 0 END) AS BB_CREDITS_WITH_DPD_COUNT, sum(BB_DPD_MONTHS) AS BB_DPD_MONTHS_COUNT,
CASE WHEN sum(BB_MONTHS_REPORTED) >= 6 THEN sum(BB_DPD_MONTHS) / sum(BB_MONTHS_REPORTED) END AS BB_PCT_MONTHS_DPD,
CASE WHEN max(BB_LAST_DPD_MONTH - BB_WINDOW_END) >= -6 THEN 1 ELSE 0 END AS BB_RECENT_DPD_FLAG_REL, CASE WHEN count(*) >= 11 THEN 1 ELSE 0 END AS BB_MANY_CREDITS_FLAG,
CASE WHEN max(BB_CREDIT_TRAJECTORY) IS NOT NULL THEN CASE WHEN max(BB_CREDIT_TRAJECTORY) = 3 THEN 1 ELSE 0 END END AS BB_PERSISTENT_DPD_FLAG,
CASE WHEN max(BB_CREDIT_TRAJECTORY) IS NOT NULL THEN CASE WHEN max(BB_CREDIT_TRAJECTORY) = 2 THEN 1 ELSE 0 END END AS BB_WORSENING_DPD_FLAG,
CASE WHEN max(BB_CREDIT_TRAJECTORY) IS NOT NULL THEN CASE WHEN max(BB_CREDIT_TRAJECTORY) = 1 THEN 1 ELSE 0 END END AS BB_RECOVERED_DPD_FLAG
FROM agg_c JOIN bridge USING (SK_ID_BUREAU) GROUP BY 1""",
)
cte(
    "prev_clean",
    "SELECT * REPLACE ("
    + ", ".join(f"nullif({c}, 365243) AS {c}" for c in C.LIFECYCLE_DATES)
    + ", "
    + ", ".join(f"CASE WHEN {c} < 0 THEN 0 ELSE {c} END AS {c}" for c in C.DOWN_PAYMENTS)
    + ") FROM prev_raw",
)
GRANT = "CASE WHEN AMT_APPLICATION > 0 AND AMT_CREDIT > 0 THEN AMT_CREDIT / AMT_APPLICATION END"
cte(
    "prev_x",
    f"""SELECT *, {GRANT} AS g, min(DAYS_DECISION) OVER w AS d0, max(DAYS_DECISION) OVER w AS d1,
NAME_CASH_LOAN_PURPOSE IS NOT NULL AND NAME_CASH_LOAN_PURPOSE NOT IN ('XNA', 'XAP') AS declared FROM prev_clean WINDOW w AS (PARTITION BY SK_ID_CURR)""",
)
cte(
    "agg_p",
    f"""SELECT SK_ID_CURR, count(*) AS PREV_APPLICATION_COUNT, min(DAYS_DECISION) AS PREV_DAYS_DECISION_MIN, max(DAYS_DECISION) AS PREV_DAYS_DECISION_MAX,
{n_if("DAYS_DECISION > -365")} AS PREV_COUNT_12M, {any_if("DAYS_DECISION = d0 AND NAME_CLIENT_TYPE IN ('Repeater', 'Refreshed')")} AS PREV_HISTORIAL_RECORTADO,
{n_if("NAME_CONTRACT_STATUS = 'Refused'")} AS PREV_REFUSED_COUNT, {n_if("NAME_CONTRACT_STATUS = 'Refused'")} / count(*) AS PREV_REFUSED_RATIO,
{any_if("NAME_CONTRACT_STATUS = 'Refused' AND CODE_REJECT_REASON = 'SCOFR'")} AS PREV_REFUSED_SCOFR_FLAG,
{any_if("CNT_PAYMENT > 60 AND NAME_CONTRACT_STATUS IS DISTINCT FROM 'Approved'")} AS PREV_REFUSED_LONG_TERM_FLAG, avg(g) AS PREV_CREDIT_APPLICATION_RATIO,
avg(CASE WHEN g > 1.2 THEN 1.0 WHEN g IS NOT NULL THEN 0.0 END) AS PREV_OVERGRANTED_RATIO, avg(CASE WHEN CNT_PAYMENT > 0 THEN CNT_PAYMENT END) AS PREV_CNT_PAYMENT_MEAN,
avg(CASE WHEN NAME_CONTRACT_STATUS = 'Approved' AND AMT_ANNUITY > 0 AND CNT_PAYMENT > 0 AND AMT_CREDIT > 0 THEN AMT_ANNUITY * CNT_PAYMENT / AMT_CREDIT END) AS PREV_IMPLIED_COST_MEAN,
avg(CASE WHEN NAME_CONTRACT_TYPE = 'Consumer loans' THEN RATE_DOWN_PAYMENT END) AS PREV_DOWN_PAYMENT_RATE_MEAN,
max(CASE WHEN DAYS_LAST_DUE_1ST_VERSION - DAYS_LAST_DUE > 365 THEN 1 WHEN DAYS_LAST_DUE_1ST_VERSION - DAYS_LAST_DUE IS NOT NULL THEN 0 END) AS PREV_EARLY_SETTLED_FLAG,
max(CASE WHEN DAYS_LAST_DUE_1ST_VERSION > 0 THEN DAYS_LAST_DUE_1ST_VERSION END) AS PREV_FUTURE_DUE_MAX,
avg(CASE WHEN PRODUCT_COMBINATION LIKE '%Street%' THEN 1.0 WHEN PRODUCT_COMBINATION IS NOT NULL THEN 0.0 END) AS PREV_STREET_RATIO,
{n_if("HOUR_APPR_PROCESS_START <= 8")} / count(*) AS PREV_EARLY_HOUR_RATIO, {n_if("NAME_TYPE_SUITE IS NULL")} / count(*) AS PREV_NO_SUITE_RATIO,
avg(CASE WHEN declared THEN CASE WHEN NAME_CASH_LOAN_PURPOSE IN ('Car repairs', 'Medicine') THEN 1.0 ELSE 0.0 END END) AS PREV_URGENT_PURPOSE_RATIO,
{any_if("PRODUCT_COMBINATION IS NULL")} AS PREV_PHANTOM_FLAG, count(*) / greatest(-min(DAYS_DECISION) / 365.25, 0.5) AS PREV_APPLICATIONS_PER_YEAR,
CASE WHEN count(*) >= 6 THEN 1 ELSE 0 END AS PREV_COUNT_COLA, CASE WHEN {n_if("DAYS_DECISION > -365")} >= 2 THEN 1 ELSE 0 END AS PREV_ACTIVIDAD_12M_COLA,
CASE WHEN {n_if("DAYS_DECISION > -365")} >= 2 AND -min(DAYS_DECISION) / 365.25 < 4 THEN 1 ELSE 0 END AS PREV_RELACION_CORTA_ACTIVA FROM prev_x GROUP BY 1""",
)
cte("cl_h", "SELECT *, CASE WHEN BUREAU_LOAN_COUNT IS NOT NULL THEN 1 ELSE 0 END AS HAS_BUREAU_HISTORY FROM app1 LEFT JOIN agg_h USING (SK_ID_CURR)")
cte(
    "cl_hb",
    "SELECT *, CASE WHEN BB_N_CREDITS_WBAL IS NOT NULL THEN 1 ELSE 0 END AS HAS_BUREAU_BALANCE, CASE WHEN BUREAU_OVERDUE_UNION IS NOT NULL THEN "
    "CASE WHEN BUREAU_OVERDUE_UNION > 0 OR BB_ANY_DPD_FLAG > 0 THEN 1 ELSE 0 END END AS BB_OVERDUE_UNION FROM cl_h LEFT JOIN agg_b USING (SK_ID_CURR)",
)
cte("cl", "SELECT *, CASE WHEN PREV_APPLICATION_COUNT IS NOT NULL THEN 1 ELSE 0 END AS HAS_PREV_APPLICATION FROM cl_hb LEFT JOIN agg_p USING (SK_ID_CURR)")
cte("cl_p", "SELECT *, CASE WHEN PREV_APPLICATION_COUNT IS NOT NULL THEN 1 ELSE 0 END AS HAS_PREV_APPLICATION FROM app1 LEFT JOIN agg_p USING (SK_ID_CURR)")
cte("lab", "SELECT SK_ID_CURR, TARGET FROM app1")
cte("hist_t", "SELECT h.*, l.TARGET FROM hist_raw h JOIN lab l USING (SK_ID_CURR)")
cte("hist_ct", "SELECT h.*, l.TARGET FROM hist_clean h JOIN lab l USING (SK_ID_CURR)")
cte("prev_t", "SELECT p.*, l.TARGET FROM prev_x p JOIN lab l USING (SK_ID_CURR)")
RELATIVE = f"""SELECT SK_ID_CURR, {any_if("NAME_CONTRACT_STATUS = 'Refused' AND DAYS_DECISION = d1")} AS PREV_EXIT_REFUSED_FLAG,
max(DAYS_DECISION - d1) FILTER (WHERE NAME_CONTRACT_STATUS = 'Refused') AS PREV_DAYS_SINCE_REFUSED_REL, {n_if("DAYS_DECISION - d1 > -365")} AS PREV_COUNT_12M_REL,
avg(CASE WHEN PRODUCT_COMBINATION LIKE '%Street%' THEN 1.0 WHEN PRODUCT_COMBINATION IS NOT NULL THEN 0.0 END) FILTER (WHERE DAYS_DECISION - d1 > -365) AS PREV_STREET_RATIO_REL,
avg(CASE WHEN HOUR_APPR_PROCESS_START <= 8 THEN 1.0 ELSE 0.0 END) FILTER (WHERE DAYS_DECISION - d1 > -365) AS PREV_EARLY_HOUR_RATIO_REL,
avg(CASE WHEN NAME_TYPE_SUITE IS NULL THEN 1.0 ELSE 0.0 END) FILTER (WHERE DAYS_DECISION - d1 > -365) AS PREV_NO_SUITE_RATIO_REL FROM prev_x GROUP BY 1"""
