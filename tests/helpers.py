"""Row builders of the small fixtures."""

HISTORY = {
    "SK_ID_CURR": "bigint", "SK_ID_BUREAU": "bigint", "CREDIT_ACTIVE": "string", "CREDIT_TYPE": "string", "CREDIT_CURRENCY": "string",
    "DAYS_CREDIT": "double", "CREDIT_DAY_OVERDUE": "double", "DAYS_CREDIT_ENDDATE": "double", "DAYS_ENDDATE_FACT": "double",
    "DAYS_CREDIT_UPDATE": "double", "CNT_CREDIT_PROLONG": "double", "AMT_CREDIT_SUM": "double", "AMT_CREDIT_SUM_DEBT": "double",
    "AMT_CREDIT_SUM_LIMIT": "double", "AMT_CREDIT_SUM_OVERDUE": "double", "AMT_CREDIT_MAX_OVERDUE": "double", "AMT_ANNUITY": "double",
}
HISTORY_DEFAULTS = {
    "CREDIT_ACTIVE": "Active", "CREDIT_TYPE": "Consumer credit", "CREDIT_CURRENCY": "currency 1", "DAYS_CREDIT": -1000.0, "CREDIT_DAY_OVERDUE": 0.0,
    "DAYS_CREDIT_ENDDATE": 100.0, "DAYS_CREDIT_UPDATE": -30.0, "CNT_CREDIT_PROLONG": 0.0, "AMT_CREDIT_SUM": 100000.0, "AMT_CREDIT_SUM_DEBT": 50000.0,
    "AMT_CREDIT_SUM_OVERDUE": 0.0,
}
PREVIOUS = {
    "SK_ID_CURR": "bigint", "DAYS_DECISION": "double", "NAME_CLIENT_TYPE": "string", "NAME_CONTRACT_STATUS": "string", "CODE_REJECT_REASON": "string",
    "CNT_PAYMENT": "double", "AMT_APPLICATION": "double", "AMT_CREDIT": "double", "AMT_ANNUITY": "double", "NAME_CONTRACT_TYPE": "string",
    "RATE_DOWN_PAYMENT": "double", "DAYS_LAST_DUE_1ST_VERSION": "double", "DAYS_LAST_DUE": "double", "PRODUCT_COMBINATION": "string",
    "HOUR_APPR_PROCESS_START": "double", "NAME_TYPE_SUITE": "string", "NAME_CASH_LOAN_PURPOSE": "string",
}
PREVIOUS_DEFAULTS = {
    "NAME_CLIENT_TYPE": "New", "NAME_CONTRACT_STATUS": "Approved", "CODE_REJECT_REASON": "XAP", "CNT_PAYMENT": 12.0, "AMT_APPLICATION": 100.0,
    "AMT_CREDIT": 100.0, "AMT_ANNUITY": 10.0, "NAME_CONTRACT_TYPE": "Cash loans", "PRODUCT_COMBINATION": "Cash X-Sell: low",
    "HOUR_APPR_PROCESS_START": 12.0, "NAME_TYPE_SUITE": "Unaccompanied", "NAME_CASH_LOAN_PURPOSE": "XAP",
}
H_CUTS = {"bureau_enddate_tramo_min_anios": 2, "bureau_enddate_tramo_max_anios": 5, "bureau_count_cola": 3}
B_CUTS = {"bb_many_credits_corte": 3}
P_CUTS = {"prev_sobreconcesion_corte": 1.1, "prev_finalidades_urgentes": ("Repairs",), "prev_count_cola": 3, "prev_actividad_12m_cola": 2}


def frame(spark, schema, defaults, rows):
    """Rows given as dicts over the defaults."""
    data = [tuple({**dict.fromkeys(schema), **defaults, **r}[c] for c in schema) for r in rows]
    return spark.createDataFrame(data, ", ".join(f"{c} {t}" for c, t in schema.items()))


def history(spark, rows):
    return frame(spark, HISTORY, HISTORY_DEFAULTS, rows)


def previous(spark, rows):
    return frame(spark, PREVIOUS, PREVIOUS_DEFAULTS, rows)


def panel(spark, credits):
    """credit -> (first month, states)."""
    rows = [(c, first + i, s) for c, (first, states) in credits.items() for i, s in enumerate(states)]
    return spark.createDataFrame(rows, "SK_ID_BUREAU bigint, MONTHS_BALANCE int, STATUS string")


def by_key(df, key="SK_ID_CURR"):
    """Collected rows by key."""
    return {r[key]: r.asDict() for r in df.collect()}
