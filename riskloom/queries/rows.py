"""Queries of the row-level families: sources, cleaning, features, joins, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import cleaning as C
from riskloom.operators import features as X
from riskloom.operators import joins as J
from riskloom.operators import panel as B
from riskloom.operators import previous as V
from riskloom.operators.audits import null_mechanism
from riskloom.operators.history import aggregate_history
from riskloom.operators.ranks import average_ranks, prefix_by_value, unique_ranks
from riskloom.operators.signals import crosstab
from riskloom.operators.woe import rate_by
from riskloom.plans.assemble import assemble
from riskloom.queries import standin as S
from riskloom.queries.base import B_CUTS, CUTS, H_CUTS, P_CUTS, RELATIVE, RESIDUAL, any_if, app, clients, hist, hist_t, labels, n_if
from riskloom.queries.registry import add

K = "SK_ID_CURR"

# -- cleaning ----------------------------------------------------------------------------------

add("C1_residual_rows", lambda s, d: S.application(s, d).filter(C.residual_rows(S.application(s, d))).select(K), f"SELECT {K} FROM app_raw WHERE {RESIDUAL}")
add(
    "C2_structural_drops",
    lambda s, d: C.drop_redundant(S.application(s, d)),
    "SELECT * EXCLUDE (FLAG_MOBIL, FLAG_EMP_PHONE, OBS_60_CNT_SOCIAL_CIRCLE, APARTMENTS_MODE, APARTMENTS_MEDI) FROM app_raw",
    (APP_TEXT := (
        "CODE_GENDER", "NAME_FAMILY_STATUS", "NAME_CONTRACT_TYPE", "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "NAME_TYPE_SUITE", "NAME_INCOME_TYPE",
        "NAME_HOUSING_TYPE", "NAME_EDUCATION_TYPE", "OCCUPATION_TYPE", "ORGANIZATION_TYPE", "WEEKDAY_APPR_PROCESS_START", "FONDKAPREMONT_MODE",
        "HOUSETYPE_MODE", "WALLSMATERIAL_MODE", "EMERGENCYSTATE_MODE",
    )),
)
add(
    "C4_sentinel_flag",
    lambda s, d: C.sentinel_to_null(C.sentinel_to_null(S.application(s, d))).select(K, "DAYS_EMPLOYED", C.ANOMALY_FLAG),
    f"SELECT {K}, nullif(DAYS_EMPLOYED, 365243) AS DAYS_EMPLOYED, CASE WHEN DAYS_EMPLOYED = 365243 THEN 1 ELSE 0 END AS {C.ANOMALY_FLAG} FROM app_raw",
)
add(
    "C5_domain_cap",
    lambda s, d: C.cap_requests(S.application(s, d)).select(K, "AMT_REQ_CREDIT_BUREAU_DAY"),
    f"SELECT {K}, CASE WHEN AMT_REQ_CREDIT_BUREAU_DAY > 5 THEN 5 ELSE AMT_REQ_CREDIT_BUREAU_DAY END AS AMT_REQ_CREDIT_BUREAU_DAY FROM app_raw",
)
_SIGNS = [f"{c}_SIGNO" for c in C.SIGNED_AMOUNTS]
add(
    "C6_sign_snapshot",
    lambda s, d: C.snapshot_signs(S.history(s, d)).select("SK_ID_BUREAU", *_SIGNS),
    "SELECT SK_ID_BUREAU, " + ", ".join(f"sign({c}) AS {c}_SIGNO" for c in C.SIGNED_AMOUNTS) + " FROM hist_raw",
)
add(
    "C7_foreign_currency",
    lambda s, d: C.mask_foreign_currency(S.history(s, d)).select("SK_ID_BUREAU", C.FOREIGN_FLAG, *C.HISTORY_AMOUNTS),
    f"SELECT SK_ID_BUREAU, {C.FOREIGN_FLAG}, " + ", ".join(C.HISTORY_AMOUNTS) + " FROM hist1",
    digits=4,
)
add(
    "C8_implausible_amounts",
    lambda s, d: C.null_implausible_amounts(S.history(s, d)).select("SK_ID_BUREAU", *C.AMOUNT_CAPS),
    "SELECT SK_ID_BUREAU, " + ", ".join(f"CASE WHEN {c} > {k} THEN NULL ELSE {c} END AS {c}" for c, k in C.AMOUNT_CAPS.items()) + " FROM hist_raw",
    digits=4,
)
add(
    "C9_debt_cap",
    lambda s, d: C.cap_debt(S.history(s, d)).select("SK_ID_BUREAU", "AMT_CREDIT_SUM_DEBT"),
    "SELECT SK_ID_BUREAU, CASE WHEN AMT_CREDIT_SUM > 0 AND AMT_CREDIT_SUM_DEBT / nullif(AMT_CREDIT_SUM, 0) > 3 THEN AMT_CREDIT_SUM ELSE AMT_CREDIT_SUM_DEBT END AS AMT_CREDIT_SUM_DEBT FROM hist_raw",
    digits=4,
)
add(
    "C10_date_windows",
    lambda s, d: C.bound_dates(S.history(s, d)).select("SK_ID_BUREAU", *C.PAST_LIMITED_DATES),
    "SELECT SK_ID_BUREAU, CASE WHEN DAYS_CREDIT_ENDDATE BETWEEN -10957.5 AND 7305 THEN DAYS_CREDIT_ENDDATE END AS DAYS_CREDIT_ENDDATE, "
    "CASE WHEN DAYS_ENDDATE_FACT >= -10957.5 THEN DAYS_ENDDATE_FACT END AS DAYS_ENDDATE_FACT, CASE WHEN DAYS_CREDIT_UPDATE >= -10957.5 THEN DAYS_CREDIT_UPDATE END AS DAYS_CREDIT_UPDATE FROM hist_raw",
)
_HIST_TEXT = ("CREDIT_ACTIVE", "CREDIT_TYPE", "CREDIT_CURRENCY")
add("C11_clean_history", lambda s, d: C.clean_history(hist(s, d)), "SELECT * FROM hist_clean", _HIST_TEXT, digits=4)
add(
    "C12_normal_status",
    lambda s, d: S.panel(s, d).groupBy(F.col("STATUS").alias("raw"), C.normal_status().alias("status")).agg(F.count(F.lit(1)).alias("n")),
    "SELECT STATUS AS raw, upper(trim(STATUS)) AS status, count(*) AS n FROM panel_raw GROUP BY 1, 2",
    ("raw", "status"),
)
add(
    "C13_panel_decode",
    lambda s, d: C.clean_panel(S.panel(s, d)),
    "SELECT * FROM panel_clean",
    ("STATUS",),
)
_PREV_TEXT = (*V.TEXTS,)
add("C14_clean_previous", lambda s, d: C.clean_previous(S.previous(s, d)), "SELECT * FROM prev_clean", _PREV_TEXT)
add("C15_clean_for_scoring", lambda s, d: C.clean_application(S.application(s, d)), "SELECT * FROM app_score", APP_TEXT)
add("C16_clean_for_training", lambda s, d: C.clean_training_application(S.application(s, d)), "SELECT * FROM app_clean", APP_TEXT)
add("C17_feature_matrix", lambda s, d: C.feature_matrix(app(s, d)), f"SELECT * EXCLUDE ({K}, TARGET) FROM app1", APP_TEXT)
add(
    "C18_boundary_types",
    lambda s, d: C.fix_types(aggregate_history(S.history(s, d), H_CUTS), ["BUREAU_LOAN_COUNT", "HAS_BEEN_PROLONGED", "BUREAU_DEBT_CREDIT_RATIO"]).select(
        K, "BUREAU_LOAN_COUNT", "HAS_BEEN_PROLONGED", "BUREAU_DEBT_CREDIT_RATIO"
    ),
    f"SELECT {K}, BUREAU_LOAN_COUNT, HAS_BEEN_PROLONGED, BUREAU_DEBT_CREDIT_RATIO FROM agg_h",
)
PART_SQL = "CASE WHEN HOUR_APPR_PROCESS_START >= 6 AND HOUR_APPR_PROCESS_START < 12 THEN 'manana' WHEN HOUR_APPR_PROCESS_START >= 12 AND HOUR_APPR_PROCESS_START < 18 THEN 'tarde' WHEN HOUR_APPR_PROCESS_START IS NOT NULL THEN 'fuera de horario' END"
DAY_SQL = "CASE WHEN WEEKDAY_APPR_PROCESS_START IN ('SATURDAY', 'SUNDAY') THEN 'fin de semana' WHEN WEEKDAY_APPR_PROCESS_START IN ('MONDAY', 'TUESDAY', 'WEDNESDAY', 'THURSDAY', 'FRIDAY') THEN 'entresemana' ELSE WEEKDAY_APPR_PROCESS_START END"
add("C19_day_part", lambda s, d: C.recode_domain(S.application(s, d)).select(K, C.DAY_PART), f"SELECT {K}, {PART_SQL} AS HORA_FRANJA FROM app_raw", ("HORA_FRANJA",))
add("C20_day_kind", lambda s, d: C.recode_domain(C.recode_domain(S.application(s, d))).select(K, C.WEEKDAY), f"SELECT {K}, {DAY_SQL} AS {C.WEEKDAY} FROM app_raw", (C.WEEKDAY,))
add("C21_missing_occupation", lambda s, d: C.recode_domain(S.application(s, d)).select(K, C.OCCUPATION), f"SELECT {K}, coalesce(OCCUPATION_TYPE, 'Sin declarar') AS OCCUPATION_TYPE FROM app_raw", (C.OCCUPATION,))
add(
    "C22_sane_names",
    lambda s, d: C.sanitise_names(S.application(s, d).select(F.col(K).alias("id, of client"), F.col("TARGET").alias("bad?"))),
    f"SELECT {K} AS id__of_client, TARGET AS bad_ FROM app_raw",
)

# -- scalar features ---------------------------------------------------------------------------

add("F1_building_block", lambda s, d: app(s, d).select(K, "BUILDING_INFO_COUNT", "HAS_BUILDING_INFO"), f"SELECT {K}, BUILDING_INFO_COUNT, HAS_BUILDING_INFO FROM app1")
add("F2_block_presence", lambda s, d: app(s, d).select(K, "HAS_BUREAU_INFO", "HAS_SOCIAL_INFO"), f"SELECT {K}, HAS_BUREAU_INFO, HAS_SOCIAL_INFO FROM app1")
add("F3_score_absence", lambda s, d: app(s, d).select(K, "FLAG_EXT_SOURCE_1_NULL", "FLAG_EXT_SOURCE_3_NULL"), f"SELECT {K}, FLAG_EXT_SOURCE_1_NULL, FLAG_EXT_SOURCE_3_NULL FROM app1")
add("F4_ratios", lambda s, d: app(s, d).select(K, "AGE_YEARS", "EMPLOYED_TO_AGE_RATIO", "LTV"), f"SELECT {K}, AGE_YEARS, EMPLOYED_TO_AGE_RATIO, LTV FROM app1")
add("F5_layer_one", lambda s, d: app(s, d), "SELECT * FROM app1", APP_TEXT)
add(
    "F7_late_ratios",
    lambda s, d: X.add_late_ratios(app(s, d)).select(K, *X.LATE_RATIOS),
    f"SELECT {K}, AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0) AS ANNUITY_TO_INCOME_RATIO, CNT_CHILDREN / nullif(CNT_FAM_MEMBERS, 0) AS CHILDREN_TO_FAM_RATIO FROM app1",
)
add("F8_term_end_date", lambda s, d: hist(s, d).select("SK_ID_BUREAU", X.term_end_date().alias("term_end")), "SELECT SK_ID_BUREAU, CASE WHEN CREDIT_TYPE IS DISTINCT FROM 'Credit card' THEN DAYS_CREDIT_ENDDATE END AS term_end FROM hist_clean")
add("F9_grant_ratio", lambda s, d: S.previous(s, d).select("SK_ID_PREV", X.grant_ratio().alias("grant_ratio")), "SELECT SK_ID_PREV, g AS grant_ratio FROM prev_x")
add("F10_declared_purpose", lambda s, d: S.previous(s, d).select("SK_ID_PREV", X.purpose_declared().cast("int").alias("declared")), "SELECT SK_ID_PREV, CASE WHEN declared THEN 1 ELSE 0 END AS declared FROM prev_x")
add("F11_defined_combination", lambda s, d: S.previous(s, d).select("SK_ID_PREV", X.combination_defined().cast("int").alias("defined")), "SELECT SK_ID_PREV, CASE WHEN PRODUCT_COMBINATION IS NULL THEN 0 ELSE 1 END AS defined FROM prev_raw")
add(
    "F12_recent_mask",
    lambda s, d: V.with_window_end(C.clean_previous(S.previous(s, d)), "fin")
    .select("SK_ID_PREV", X.is_recent(365).cast("int").alias("recent"), X.is_recent(365, F.col("fin")).cast("int").alias("recent_rel")),
    "SELECT SK_ID_PREV, CASE WHEN DAYS_DECISION > -365 THEN 1 ELSE 0 END AS recent, CASE WHEN DAYS_DECISION - d1 > -365 THEN 1 ELSE 0 END AS recent_rel FROM prev_x",
)
_ARREARS = "CASE WHEN HAS_BUREAU_HISTORY = 1 THEN CASE WHEN BUREAU_OVERDUE_UNION = 1 THEN 'con_mora' WHEN HAS_BUREAU_OVERDUE_HISTORY = 1 THEN 'reportada_cero' ELSE 'sin_reportar' END END"
add("F13_arrears_state", lambda s, d: clients(s, d, "h").select(K, X.arrears_state().alias("state")), f"SELECT {K}, {_ARREARS} AS state FROM cl_h", ("state",))
add(
    "F14_annuity_state",
    lambda s, d: clients(s, d, "h").select(K, X.annuity_state().alias("state")),
    f"SELECT {K}, CASE WHEN HAS_BUREAU_HISTORY = 1 THEN CASE WHEN HAS_BUREAU_ANNUITY = 0 THEN 'sin_cuota' WHEN BUREAU_CREDITS_WITH_ANNUITY_COUNT = 0 THEN 'cuota_cero' ELSE 'cuota_con_valor' END END AS state FROM cl_h",
    ("state",),
)
add("F15_identity_ages", lambda s, d: X.identity_ages(app(s, d)).select(K, "EDAD_A_ID", "EDAD_A_REGISTRO"), f"SELECT {K}, DAYS_BIRTH - DAYS_ID_PUBLISH AS EDAD_A_ID, DAYS_BIRTH - DAYS_REGISTRATION AS EDAD_A_REGISTRO FROM app1")
add(
    "F16_logit",
    lambda s, d: app(s, d).select(K, X.logit(F.col("EXT_SOURCE_1")).alias("logit")),
    f"SELECT {K}, ln(p / (1 - p)) AS logit FROM (SELECT {K}, CASE WHEN EXT_SOURCE_1 < 1e-6 THEN 1e-6 WHEN EXT_SOURCE_1 > 1 - 1e-6 THEN 1 - 1e-6 ELSE EXT_SOURCE_1 END AS p FROM app1)",
)

# -- aggregates and joins ----------------------------------------------------------------------

add("G1_history_per_client", lambda s, d: aggregate_history(S.history(s, d), H_CUTS), "SELECT * FROM agg_h")
_CREDIT_TEXT = ("BB_LAST_STATUS",)
add("G2_panel_per_credit", lambda s, d: B.aggregate_credits(S.panel(s, d)), "SELECT * FROM agg_c", _CREDIT_TEXT)
add(
    "G3_trajectory",
    lambda s, d: B.aggregate_credits(S.panel(s, d)).select("SK_ID_BUREAU", "BB_WORST_OLD_HALF", "BB_WORST_RECENT_HALF", B.trajectory_label(F.col("BB_CREDIT_TRAJECTORY")).alias("trajectory")),
    "SELECT SK_ID_BUREAU, BB_WORST_OLD_HALF, BB_WORST_RECENT_HALF, CASE BB_CREDIT_TRAJECTORY WHEN 0 THEN 'sin mora' WHEN 1 THEN 'mejora' WHEN 2 THEN 'empeora' WHEN 3 THEN 'estable' END AS trajectory FROM agg_c",
    ("trajectory",),
)
add("G4_panel_per_client", lambda s, d: B.aggregate_panel(S.panel(s, d), B.credit_bridge(S.history(s, d)), B_CUTS), "SELECT * FROM agg_b", ("BB_TRAJECTORY",))
add("G5_previous_per_client", lambda s, d: V.aggregate_previous(S.previous(s, d), P_CUTS), "SELECT * FROM agg_p")
add(
    "G6_live_only_end",
    lambda s, d: V.live_only_end(S.previous(s, d)),
    f"SELECT {K}, max(CASE WHEN DAYS_LAST_DUE_1ST_VERSION > 0 AND DAYS_LAST_DUE IS NULL THEN DAYS_LAST_DUE_1ST_VERSION END) AS PREV_FUTURE_DUE_VIVAS FROM prev_clean GROUP BY 1",
)
add("G7_relative_recency", lambda s, d: V.relative_recency(S.previous(s, d)), RELATIVE)
add(
    "G8_denominator_counts",
    lambda s, d: V.denominator_counts(S.previous(s, d)),
    f"SELECT {K}, count(*) AS PREV_REFUSED_RATIO, count(g) AS PREV_OVERGRANTED_RATIO, count(PRODUCT_COMBINATION) AS PREV_STREET_RATIO, count(*) AS PREV_NO_SUITE_RATIO, count(*) AS PREV_EARLY_HOUR_RATIO, {n_if('declared')} AS PREV_URGENT_PURPOSE_RATIO FROM prev_x GROUP BY 1",
)
add(
    "G9_rate_by_group",
    lambda s, d: rate_by(hist_t(s, d), "CREDIT_ACTIVE"),
    "SELECT CREDIT_ACTIVE, count(*) AS n, avg(TARGET) AS rate FROM hist_t GROUP BY 1",
    ("CREDIT_ACTIVE",),
)
add(
    "G10_crosstab",
    lambda s, d: crosstab(S.history(s, d), "CREDIT_ACTIVE", "CREDIT_TYPE"),
    "SELECT a, b, n, n_row, n_col, n_all, n / n_row AS row_share, n / n_col AS col_share, n_row * n_col / n_all AS expected FROM (SELECT *, sum(n) OVER (PARTITION BY a) AS n_row, sum(n) OVER (PARTITION BY b) AS n_col, sum(n) OVER () AS n_all FROM (SELECT CREDIT_ACTIVE AS a, CREDIT_TYPE AS b, count(*) AS n FROM hist_raw GROUP BY 1, 2))",
    ("a", "b"),
)
_STATES = ("Active", "Closed", "Sold", "Bad debt")


def _pivot(s, d):
    g = hist_t(s, d).groupBy("CREDIT_TYPE").pivot("CREDIT_ACTIVE", list(_STATES)).agg(F.count(F.lit(1)).alias("n"), F.avg("TARGET").alias("rate"))
    return g.select("CREDIT_TYPE", *[F.col(f"`{x}_{m}`").alias(f"{m}_{x.replace(' ', '_').lower()}") for x in _STATES for m in ("n", "rate")])


add(
    "G11_two_way_pivot",
    _pivot,
    "SELECT CREDIT_TYPE, "
    + ", ".join(f"nullif(count(*) FILTER (WHERE CREDIT_ACTIVE = '{x}'), 0) AS n_{x.replace(' ', '_').lower()}, avg(TARGET) FILTER (WHERE CREDIT_ACTIVE = '{x}') AS rate_{x.replace(' ', '_').lower()}" for x in _STATES)
    + " FROM hist_t GROUP BY 1",
    ("CREDIT_TYPE",),
)


def _folded(s, d):
    rows = hist_t(s, d)
    total = rows.agg(F.count(F.lit(1))).scalar()
    shares = rows.groupBy("CREDIT_ACTIVE").agg((F.count(F.lit(1)) / total).alias("share"))
    named = shares.select("CREDIT_ACTIVE", F.when(F.col("share") > 0.10, F.col("CREDIT_ACTIVE")).otherwise("Other").alias("level"))
    return rate_by(J.lookup(rows, named, "CREDIT_ACTIVE", "level"), "level")


add(
    "G12_fold_small_levels",
    _folded,
    "SELECT level, count(*) AS n, avg(TARGET) AS rate FROM (SELECT TARGET, CASE WHEN count(*) OVER (PARTITION BY CREDIT_ACTIVE) / count(*) OVER () > 0.10 THEN CREDIT_ACTIVE ELSE 'Other' END AS level FROM hist_t) GROUP BY 1",
    ("level",),
)
add("J1_join_history", lambda s, d: clients(s, d, "h").select(K, "TARGET", "HAS_BUREAU_HISTORY", "BUREAU_LOAN_COUNT", "BUREAU_DEBT_CREDIT_RATIO"), f"SELECT {K}, TARGET, HAS_BUREAU_HISTORY, BUREAU_LOAN_COUNT, BUREAU_DEBT_CREDIT_RATIO FROM cl_h")
add("J2_join_previous", lambda s, d: clients(s, d, "p").select(K, "HAS_PREV_APPLICATION", "PREV_APPLICATION_COUNT", "PREV_REFUSED_RATIO"), f"SELECT {K}, HAS_PREV_APPLICATION, PREV_APPLICATION_COUNT, PREV_REFUSED_RATIO FROM cl_p")
add("J3_join_panel", lambda s, d: clients(s, d, "hb").select(K, "HAS_BUREAU_BALANCE", "BB_MONTHS_TOTAL", "BB_OVERDUE_UNION"), f"SELECT {K}, HAS_BUREAU_BALANCE, BB_MONTHS_TOTAL, BB_OVERDUE_UNION FROM cl_hb")
add("J4_bridge", lambda s, d: B.credit_bridge(S.history(s, d)), "SELECT SK_ID_BUREAU, SK_ID_CURR FROM hist_raw")
add("J5_bridge_join", lambda s, d: B.attach_clients(B.aggregate_credits(S.panel(s, d)), B.credit_bridge(S.history(s, d))).select("SK_ID_BUREAU", K, "BB_MONTHS_OBS"), f"SELECT SK_ID_BUREAU, {K}, BB_MONTHS_OBS FROM agg_c JOIN bridge USING (SK_ID_BUREAU)")
add("J6_train_history", lambda s, d: J.inherit(hist(s, d), labels(s, d)).select("SK_ID_BUREAU", K, "TARGET", "AMT_CREDIT_SUM_DEBT"), f"SELECT SK_ID_BUREAU, {K}, TARGET, AMT_CREDIT_SUM_DEBT FROM hist_ct", digits=4)


def _assembled(s, d):
    return assemble(app(s, d), S.history(s, d), S.panel(s, d), S.previous(s, d), CUTS)


add("J7_assemble", _assembled, "SELECT * FROM cl", (*APP_TEXT, "BB_TRAJECTORY"))
add("J8_members", lambda s, d: J.members(S.history(s, d), labels(s, d)).select("SK_ID_BUREAU"), f"SELECT SK_ID_BUREAU FROM hist_raw WHERE {K} IN (SELECT {K} FROM lab)")
add("J9_orphans", lambda s, d: J.orphans(S.panel(s, d), S.history(s, d), "SK_ID_BUREAU").groupBy("SK_ID_BUREAU").agg(F.count(F.lit(1)).alias("n")), "SELECT SK_ID_BUREAU, count(*) AS n FROM panel_raw WHERE SK_ID_BUREAU NOT IN (SELECT SK_ID_BUREAU FROM hist_raw) GROUP BY 1")
add(
    "J10_reindex",
    lambda s, d: J.reindex(labels(s, d), V.live_only_end(S.previous(s, d))).join(J.reindex(labels(s, d), S.history(s, d).groupBy(K).agg(F.count(F.lit(1)).alias("n")), fill=0), K),
    f"SELECT {K}, v AS PREV_FUTURE_DUE_VIVAS, coalesce(n, 0) AS n FROM lab LEFT JOIN (SELECT {K}, max(CASE WHEN DAYS_LAST_DUE_1ST_VERSION > 0 AND DAYS_LAST_DUE IS NULL THEN DAYS_LAST_DUE_1ST_VERSION END) AS v FROM prev_clean GROUP BY 1) USING ({K}) LEFT JOIN (SELECT {K}, count(*) AS n FROM hist_raw GROUP BY 1) USING ({K})",
)
add(
    "J11_lookup",
    lambda s, d: J.lookup(
        app(s, d).select(K, "OCCUPATION_TYPE"), rate_by(app(s, d).filter("NAME_HOUSING_TYPE = 'With parents' AND OCCUPATION_TYPE <> 'Managers'"), "OCCUPATION_TYPE"), "OCCUPATION_TYPE", "rate", 0.0
    ).select(K, "rate"),
    f"SELECT {K}, coalesce(r, 0) AS rate FROM app1 LEFT JOIN (SELECT OCCUPATION_TYPE AS o, avg(TARGET) AS r FROM app1 WHERE NAME_HOUSING_TYPE = 'With parents' AND OCCUPATION_TYPE <> 'Managers' GROUP BY 1) ON OCCUPATION_TYPE IS NOT DISTINCT FROM o",
)


def _labelled_months(s, d):
    """Months of the panel with the target of their client. The label meets the credit first, so the months are neither dealt by client nor sorted."""
    credits = J.inherit(B.credit_bridge(S.history(s, d)), labels(s, d))
    return J.inherit(C.clean_panel(S.panel(s, d)), credits.hint("shuffle_hash"), "TARGET", "SK_ID_BUREAU")


add("J12_inherit_target", lambda s, d: rate_by(_labelled_months(s, d), "STATUS"), "SELECT STATUS, count(*) AS n, avg(TARGET) AS rate FROM panel_clean JOIN bridge USING (SK_ID_BUREAU) JOIN lab USING (SK_ID_CURR) GROUP BY 1", ("STATUS",))

# -- windows and ordered panel -----------------------------------------------------------------

add(
    "W1_window_halves",
    lambda s, d: B.with_window(C.clean_panel(S.panel(s, d))).select("SK_ID_BUREAU", "MONTHS_BALANCE", B.is_recent_half().cast("int").alias("recent")),
    "SELECT SK_ID_BUREAU, MONTHS_BALANCE, CASE WHEN is_recent THEN 1 ELSE 0 END AS recent FROM panel_halves",
)
add("W2_oldest_rows", lambda s, d: V.oldest_rows(C.clean_previous(S.previous(s, d))).select("SK_ID_PREV", "is_oldest"), "SELECT SK_ID_PREV, CASE WHEN DAYS_DECISION = d0 THEN 1 ELSE 0 END AS is_oldest FROM prev_x")
add("W3_window_end", lambda s, d: V.with_window_end(C.clean_previous(S.previous(s, d)), "fin").select("SK_ID_PREV", "fin"), "SELECT SK_ID_PREV, d1 AS fin FROM prev_x")
add("W4_last_state", lambda s, d: B.last_state(C.clean_panel(S.panel(s, d))), "SELECT SK_ID_BUREAU, arg_max(STATUS, MONTHS_BALANCE) AS last_status, max(MONTHS_BALANCE) AS last_month FROM panel_clean GROUP BY 1", ("last_status",))
_LEAD = "SELECT *, lead(STATUS) OVER w AS next_status, CASE WHEN lead(MONTHS_BALANCE) OVER w - MONTHS_BALANCE = 1 THEN 1 ELSE 0 END AS is_consecutive, coalesce(lag(BB_IS_DPD) OVER w, 0) AS prev_dpd FROM panel_clean WINDOW w AS (PARTITION BY SK_ID_BUREAU ORDER BY MONTHS_BALANCE)"
add(
    "W5_next_state",
    lambda s, d: B.with_next_state(C.clean_panel(S.panel(s, d))).select("SK_ID_BUREAU", "MONTHS_BALANCE", "STATUS", "next_status", "is_consecutive"),
    f"SELECT SK_ID_BUREAU, MONTHS_BALANCE, STATUS, next_status, is_consecutive FROM ({_LEAD})",
    ("STATUS", "next_status"),
)
add(
    "W6_roll_rates",
    lambda s, d: B.roll_rates(S.panel(s, d)),
    f"SELECT STATUS, next_status, n, n / sum(n) OVER (PARTITION BY STATUS) AS share FROM (SELECT STATUS, next_status, count(*) AS n FROM ({_LEAD}) WHERE is_consecutive = 1 AND BB_DPD IS NOT NULL GROUP BY 1, 2)",
    ("STATUS", "next_status"),
)
_PATH = f"""SELECT SK_ID_BUREAU, {n_if("BB_IS_DPD = 1 AND prev_dpd = 0")} AS episodes, {any_if("is_consecutive = 1 AND STATUS = '1'")} AS passed_level_1,
{any_if("is_consecutive = 1 AND STATUS = '1' AND next_status IN ('2', '3', '4', '5')")} AS escalated, {any_if("is_consecutive = 1 AND STATUS = '1' AND next_status IN ('0', 'C')")} AS cured,
min(MONTHS_BALANCE) FILTER (WHERE BB_IS_DPD = 1) - min(MONTHS_BALANCE) AS months_to_first_arrears FROM ({_LEAD}) GROUP BY 1"""
add("W7_episodes", lambda s, d: B.arrears_path(S.panel(s, d)).select("SK_ID_BUREAU", "episodes"), f"SELECT SK_ID_BUREAU, episodes FROM ({_PATH})")
add("W8_escalated_or_cured", lambda s, d: B.arrears_path(S.panel(s, d)).select("SK_ID_BUREAU", "passed_level_1", "escalated", "cured"), f"SELECT SK_ID_BUREAU, passed_level_1, escalated, cured FROM ({_PATH})")
add("W9_months_to_arrears", lambda s, d: B.arrears_path(S.panel(s, d)).select("SK_ID_BUREAU", "months_to_first_arrears"), f"SELECT SK_ID_BUREAU, months_to_first_arrears FROM ({_PATH})")
add(
    "W10_average_rank",
    lambda s, d: average_ranks(S.read(s, d, "lineitem"), "l_extendedprice"),
    "SELECT l_extendedprice, count(*) AS n, avg(rn) AS rank FROM (SELECT l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) AS rn FROM lineitem) GROUP BY 1",
)
add(
    "W11_unique_rank",
    lambda s, d: unique_ranks(S.read(s, d, "orders").select("o_orderkey", "o_orderstatus", F.pmod("o_orderkey", F.lit(50)).alias("score")), "score", "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "rank", "tot_n"),
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey % 50, md5(o_orderkey || '|tie'), o_orderkey) AS rank, count(*) OVER (PARTITION BY o_orderstatus) AS tot_n FROM orders",
)
add(
    "W12_prefix_sums",
    lambda s, d: prefix_by_value(S.read(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"], {"qty": F.sum("l_quantity")}).select("l_returnflag", "l_extendedprice", "n", "qty", "cum_n", "cum_qty", "tot_n", "tot_qty"),
    "SELECT *, sum(n) OVER w AS cum_n, sum(qty) OVER w AS cum_qty, sum(n) OVER (PARTITION BY l_returnflag) AS tot_n, sum(qty) OVER (PARTITION BY l_returnflag) AS tot_qty FROM (SELECT l_returnflag, l_extendedprice, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_extendedprice)",
    ("l_returnflag",),
    digits=3,
)


def _raw_months(s, d):
    rows = S.read(s, d, "lineitem").select(F.col("l_orderkey").alias("SK_ID_BUREAU"), (-F.floor(F.datediff(F.lit("2001-12-31"), "l_shipdate") / 30)).cast("int").alias("MONTHS_BALANCE"))
    return B.guard_months(rows)


add(
    "W13_repeated_months",
    _raw_months,
    "SELECT SK_ID_BUREAU, count(*) AS n_rows, min(m) AS ini, max(m) AS fin, count(DISTINCT m) AS n_months, CASE WHEN max(m) - min(m) + 1 <> count(DISTINCT m) THEN 1 ELSE 0 END AS has_gap, CASE WHEN count(*) <> count(DISTINCT m) THEN 1 ELSE 0 END AS has_repeat FROM (SELECT l_orderkey AS SK_ID_BUREAU, -floor(date_diff('day', CAST(l_shipdate AS DATE), DATE '2001-12-31') / 30) AS m FROM lineitem) GROUP BY 1",
)


def _top_levels(s, d):
    return null_mechanism(hist_t(s, d), ["AMT_ANNUITY", "AMT_CREDIT_MAX_OVERDUE", "DAYS_CREDIT_ENDDATE"], "CREDIT_TYPE", {})["top"]


add(
    "W14_top_levels",
    _top_levels,
    "SELECT feature, level, nulls, nulls / sum(nulls) OVER (PARTITION BY feature) * 100 AS of_all_nulls, row_number() OVER (PARTITION BY feature ORDER BY nulls DESC, level) AS rk FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CREDIT_TYPE AS level, count(*) FILTER (WHERE {c} IS NULL) AS nulls FROM hist_t GROUP BY 2" for c in ("AMT_ANNUITY", "AMT_CREDIT_MAX_OVERDUE", "DAYS_CREDIT_ENDDATE"))
    + ") QUALIFY rk <= 2",
    ("feature", "level"),
)
