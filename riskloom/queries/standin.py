"""The driver tables seen as a credit-application schema.

One SQL expression per column, in the dialect both engines share, so that a query and its DuckDB
counterpart start from the same rows. Missing values, sentinels, foreign currencies, orphans and
clients without history are induced by arithmetic on the keys. Every row comes from a driver table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.features import BUILDING

_WEEK = ("MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY")


def _pick(expr: str, values, last: str | None = None) -> str:
    """CASE over consecutive integer values of an expression."""
    values = list(values)
    tail = f" ELSE {last}" if last else ""
    whens = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {expr} {whens}{tail} END"


def _text(*values: str) -> list[str]:
    return ["NULL" if v is None else f"'{v}'" for v in values]


def _dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def application_columns() -> dict[str, str]:
    """Main table, one row per customer; the target is a negative balance."""
    k, b = "c_custkey", "c_acctbal"
    cols = {
        "SK_ID_CURR": k,
        "TARGET": f"CASE WHEN {b} < 0 THEN 1 ELSE 0 END",
        "CODE_GENDER": f"CASE WHEN {k} % 97 = 0 THEN 'XNA' WHEN {k} % 2 = 0 THEN 'F' ELSE 'M' END",
        "NAME_FAMILY_STATUS": f"CASE WHEN {k} % 101 = 0 THEN 'Unknown' ELSE " + _pick(f"{k} % 4", _text("Married", "Single / not married", "Widow", "Separated")) + " END",
        "CNT_FAM_MEMBERS": _dbl(f"CASE WHEN {k} % 89 = 0 THEN NULL ELSE 1 + {k} % 5 + CASE WHEN {k} % 140 = 1 THEN 12 ELSE 0 END END"),
        "CNT_CHILDREN": _dbl(f"{k} % 3 + CASE WHEN {k} % 131 = 0 THEN 9 ELSE 0 END"),
        "DAYS_LAST_PHONE_CHANGE": _dbl(f"CASE WHEN {k} % 211 = 0 THEN NULL ELSE -(({k} * 37) % 4000) END"),
        "AMT_ANNUITY": _dbl(f"CASE WHEN {k} % 53 = 0 THEN NULL ELSE abs({b}) * 1e-1 + 1e0 END"),
        "AMT_INCOME_TOTAL": _dbl(f"(abs({b}) + 1e2) * CASE WHEN {k} % 113 = 0 THEN 50 ELSE 1 END"),
        "AMT_CREDIT": _dbl(f"(({k} * 7919) % 10007) * 10 + 5000"),
        "AMT_GOODS_PRICE": _dbl(f"CASE WHEN {k} % 151 = 0 THEN 0e0 WHEN {k} % 61 = 0 THEN NULL ELSE ((({k} * 7919) % 10007) * 10 + 5000) * 9e-1 END"),
        "REGION_POPULATION_RELATIVE": _dbl("(c_nationkey + 1) * 1e-3"),
        "DAYS_BIRTH": _dbl(f"-(7000 + ({k} * 31) % 97)"),
        "DAYS_EMPLOYED": _dbl(f"CASE WHEN {k} % 6 = 0 THEN 365243 ELSE -(({k} * 13) % 9000) END"),
        "DAYS_REGISTRATION": _dbl(f"-(({k} * 7) % 11)"),
        "DAYS_ID_PUBLISH": _dbl(f"CASE WHEN {k} % 77 = 0 THEN NULL ELSE -(({k} * 5) % 13) END"),
        "OWN_CAR_AGE": _dbl(f"CASE WHEN {k} % 3 = 0 THEN ({k} * 3) % 40 + CASE WHEN {k} % 303 = 0 THEN 60 ELSE 0 END ELSE NULL END"),
        "REGION_RATING_CLIENT": _dbl(f"1 + {k} % 3"),
        "REGION_RATING_CLIENT_W_CITY": _dbl(f"1 + ({k} + 1) % 3"),
        "EXT_SOURCE_1": _dbl(f"CASE WHEN {k} % 5 = 2 THEN NULL ELSE (({k} * 104729) % 1000) * 1e-3 END"),
        "EXT_SOURCE_2": _dbl(f"CASE WHEN {k} % 59 = 0 THEN NULL ELSE ({b} + 1e3) / 7e4 + (({k} * 15485863) % 1000) * 7e-4 END"),
        "EXT_SOURCE_3": _dbl(f"CASE WHEN {k} % 8 = 0 THEN NULL ELSE ({b} + 1e3) / 3e4 + (({k} * 7919) % 1000) * 6e-4 END"),
    }
    for i, c in enumerate(BUILDING):
        gap = f"{k} % 10 = 9 OR ({k} + {i}) % {7 + i} = 0" if i % 3 else f"{k} % 10 >= 8"
        cols[c] = _dbl(f"CASE WHEN {gap} THEN NULL ELSE (({k} * {101 + i}) % 997) * 1e-3 END")
    cols["APARTMENTS_MODE"] = _dbl(f"CASE WHEN {k} % 10 = 9 THEN NULL ELSE ({k} % 97) * 1e-2 END")
    cols["APARTMENTS_MEDI"] = _dbl(f"CASE WHEN {k} % 10 = 9 THEN NULL ELSE ({k} % 89) * 1e-2 END")
    for i, w in enumerate(("HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR")):
        cols[f"AMT_REQ_CREDIT_BUREAU_{w}"] = _dbl(f"CASE WHEN {k} % 7 = 0 THEN NULL ELSE ({k} * {3 + i}) % {2 + 2 * i} + CASE WHEN {k} % 170 = 1 THEN 9 ELSE 0 END END")
    for n, d, m in (("OBS_30", 7, 5), ("DEF_30", 5, 4), ("OBS_60", 7, 5), ("DEF_60", 5, 3)):
        cols[f"{n}_CNT_SOCIAL_CIRCLE"] = _dbl(
            f"CASE WHEN {k} % 90 = 4 THEN NULL WHEN {k} % {d} = 0 THEN {k} % {m} + CASE WHEN {k} % 250 = 0 THEN 30 ELSE 0 END ELSE 0 END"
        )
    for c, cond in (
        ("FLAG_MOBIL", "1"),
        ("FLAG_EMP_PHONE", f"CASE WHEN {k} % 6 = 0 THEN 0 ELSE 1 END"),
        ("FLAG_CONT_MOBILE", f"CASE WHEN {k} % 20 = 0 THEN 0 ELSE 1 END"),
        ("FLAG_WORK_PHONE", f"CASE WHEN {b} < {k} % 3000 THEN 1 ELSE 0 END"),
        ("FLAG_PHONE", f"CASE WHEN {k} % 4 = 0 THEN 1 ELSE 0 END"),
        ("FLAG_EMAIL", f"CASE WHEN {k} % 18 = 0 THEN 1 ELSE 0 END"),
    ):
        cols[c] = cond
    for i, c in enumerate(
        ("REG_REGION_NOT_LIVE_REGION", "REG_REGION_NOT_WORK_REGION", "LIVE_REGION_NOT_WORK_REGION", "REG_CITY_NOT_LIVE_CITY", "REG_CITY_NOT_WORK_CITY", "LIVE_CITY_NOT_WORK_CITY")
    ):
        cols[c] = f"CASE WHEN {k} % {13 - i} = 0 THEN 1 ELSE 0 END"
    for i in range(2, 22):
        cols[f"FLAG_DOCUMENT_{i}"] = f"CASE WHEN {k} % {3 * i + 1} = 1 THEN 1 ELSE 0 END"
    cols |= {
        "NAME_CONTRACT_TYPE": f"CASE WHEN {k} % 9 = 0 THEN 'Revolving loans' ELSE 'Cash loans' END",
        "FLAG_OWN_CAR": f"CASE WHEN {k} % 3 = 0 THEN 'Y' ELSE 'N' END",
        "FLAG_OWN_REALTY": f"CASE WHEN {k} % 4 = 1 THEN 'N' ELSE 'Y' END",
        "NAME_TYPE_SUITE": f"CASE WHEN {k} % 71 = 0 THEN 'Group of people' ELSE " + _pick(f"{k} % 5", _text("Family", "Unaccompanied", "Unaccompanied", None, "Children")) + " END",
        "NAME_INCOME_TYPE": f"CASE WHEN {k} % 250 = 7 THEN 'Student' WHEN c_mktsegment = 'BUILDING' THEN 'Pensioner' ELSE 'Working' END",
        "NAME_HOUSING_TYPE": _pick(f"{k} % 3", _text("House / apartment", "With parents", "Rented apartment")),
        "NAME_EDUCATION_TYPE": _pick(f"{k} % 6", _text("Secondary / secondary special", "Higher education", "Incomplete higher", "Lower secondary", "Academic degree", None)),
        "OCCUPATION_TYPE": _pick(f"{k} % 7", _text("Laborers", "Core staff", "Drivers", None, "Managers", "Cooking staff", "Laborers")),
        "ORGANIZATION_TYPE": f"CASE WHEN {k} % 83 = 0 THEN NULL ELSE c_mktsegment || ' ' || CAST({k} % 4 AS STRING) END",
        "HOUR_APPR_PROCESS_START": f"CAST(CASE WHEN {k} % 67 = 0 THEN NULL ELSE {k} % 24 END AS INT)",
        "WEEKDAY_APPR_PROCESS_START": _pick(f"{k} % 8", _text(*_WEEK, "HOLIDAY")),
        "FONDKAPREMONT_MODE": _pick(f"{k} % 4", _text("reg oper account", None, None, "not specified")),
        "HOUSETYPE_MODE": f"CASE WHEN {k} % 2 = 0 THEN 'block of flats' ELSE NULL END",
        "WALLSMATERIAL_MODE": _pick(f"{k} % 3", _text("Panel", "Stone, brick", None)),
        "EMERGENCYSTATE_MODE": f"CASE WHEN {k} % 2 = 1 THEN 'No' ELSE NULL END",
    }
    return cols


def history_columns() -> dict[str, str]:
    """Credit history, one row per order; the orders of one customer in seven belong to a client unknown to the main table."""
    o, p = "o_orderkey", "o_totalprice"
    days = "DAYS_TO(o_orderdate, '2001-09-01')"
    return {
        "SK_ID_CURR": "CASE WHEN o_custkey % 7 = 3 THEN -o_custkey ELSE o_custkey END",
        "SK_ID_BUREAU": o,
        "CREDIT_ACTIVE": f"CASE WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'P' AND {o} % 5 = 0 THEN 'Sold' WHEN o_orderstatus = 'P' AND {o} % 11 = 0 THEN 'Bad debt' ELSE 'Active' END",
        "CREDIT_TYPE": "CASE o_orderpriority WHEN '1-URGENT' THEN 'Credit card' WHEN '2-HIGH' THEN 'Consumer credit' WHEN '3-MEDIUM' THEN 'Mortgage' WHEN '4-NOT SPECIFIED' THEN 'Car loan' ELSE 'Microloan' END",
        "CREDIT_CURRENCY": f"CASE WHEN {o} % 97 = 0 THEN 'currency 2' WHEN {o} % 193 = 0 THEN NULL ELSE 'currency 1' END",
        "DAYS_CREDIT": _dbl(f"-{days}"),
        "CREDIT_DAY_OVERDUE": _dbl(f"CASE WHEN {o} % 29 = 0 THEN {o} % 60 ELSE 0 END"),
        "DAYS_CREDIT_ENDDATE": _dbl(f"CASE WHEN {o} % 13 = 0 THEN NULL WHEN {o} % 301 = 0 THEN -42000 WHEN {o} % 157 = 0 THEN 31000 ELSE ({o} * 37) % 4000 - {days} END"),
        "DAYS_ENDDATE_FACT": _dbl(f"CASE WHEN o_orderstatus = 'F' THEN ({o} * 17) % 2000 - {days} ELSE NULL END"),
        "DAYS_CREDIT_UPDATE": _dbl(f"CASE WHEN {o} % 41 = 0 THEN NULL ELSE -(({o} * 31) % 1000) END"),
        "CNT_CREDIT_PROLONG": _dbl(f"CASE WHEN {o} % 23 = 0 THEN 1 ELSE 0 END"),
        "AMT_CREDIT_SUM": _dbl(f"CASE WHEN {o} % 401 = 0 THEN 6e7 WHEN {o} % 83 = 0 THEN 0e0 ELSE {p} END"),
        "AMT_CREDIT_SUM_DEBT": _dbl(f"CASE WHEN {o} % 5 = 0 THEN NULL WHEN {o} % 59 = 0 THEN {p} * 5e0 ELSE {p} * (({o} * 13) % 100) END"),
        "AMT_CREDIT_SUM_LIMIT": _dbl(f"CASE WHEN {o} % 3 = 0 THEN NULL WHEN {o} % 67 = 0 THEN -100 ELSE ({o} * 11) % 5000 END"),
        "AMT_CREDIT_SUM_OVERDUE": _dbl(f"CASE WHEN {o} % 31 = 0 THEN {o} % 100 + 1 ELSE 0 END"),
        "AMT_CREDIT_MAX_OVERDUE": _dbl(f"CASE WHEN {o} % 2 = 0 THEN NULL WHEN {o} % 15 = 0 THEN ({o} * 7) % 9000 ELSE 0 END"),
        "AMT_ANNUITY": _dbl(f"CASE WHEN {o} % 4 = 0 THEN NULL WHEN {o} % 6 = 1 THEN 0e0 WHEN {o} % 503 = 0 THEN 2e7 ELSE {p} * 5e-2 END"),
    }


def panel_status() -> str:
    """State of order ``o`` in month ``-mm``; some codes come untidy."""
    v = "(o * 7 + mm * mm * 3 + o * mm) % 23"
    code = (
        f"CASE WHEN {v} < 9 THEN '0' WHEN {v} < 14 THEN CASE WHEN o % 37 = 0 THEN ' c' ELSE 'C' END WHEN {v} < 17 THEN 'X' "
        f"WHEN o % 3 = 0 THEN '0' WHEN {v} < 19 THEN '1' WHEN {v} = 19 THEN '2' WHEN {v} = 20 THEN '3' WHEN {v} = 21 THEN '4' ELSE '5' END"
    )
    return f"CASE WHEN o % 19 = 5 THEN CASE WHEN mm % 2 = 0 THEN 'X' ELSE 'C' END ELSE {code} END"


PANEL_LAST = "CASE WHEN o % 4 = 0 THEN o % 7 ELSE 0 END"
PANEL_LENGTH = "3 + n_lines * 3 + o % 5"


def previous_columns() -> dict[str, str]:
    """Previous applications, one row per event; three in ten belong to a client unknown to the main table."""
    e, v = "event_id", "value"
    return {
        "SK_ID_PREV": e,
        "SK_ID_CURR": f"CASE WHEN {e} % 10 < 7 THEN 1 ELSE -1 END * (user_id * 10 + {e} % 10)",
        "DAYS_DECISION": _dbl(f"CASE WHEN {e} % 997 = 0 THEN 365243 ELSE -(DAYS_TO(ts, '2024-02-01') * 88 + {e} % 88) - 1 END"),
        "DAYS_FIRST_DRAWING": _dbl(f"CASE WHEN {e} % 2 = 0 THEN 365243 ELSE -({e} % 900) END"),
        "DAYS_FIRST_DUE": _dbl(f"-({e} % 1100)"),
        "DAYS_LAST_DUE_1ST_VERSION": _dbl(f"CASE WHEN {e} % 4 = 0 THEN NULL WHEN {e} % 9 = 0 THEN 365243 ELSE ({e} * 29) % 3000 - 1500 END"),
        "DAYS_LAST_DUE": _dbl(f"CASE WHEN {e} % 3 = 0 THEN NULL WHEN {e} % 8 = 0 THEN 365243 ELSE ({e} * 31) % 3000 - 1800 END"),
        "DAYS_TERMINATION": _dbl(f"CASE WHEN {e} % 5 = 0 THEN 365243 ELSE -({e} % 700) END"),
        "NAME_CLIENT_TYPE": _pick(f"{e} % 5", _text("Repeater", "New", "Refreshed", "New", "New")),
        "NAME_CONTRACT_STATUS": "CASE event_type WHEN 'purchase' THEN 'Refused' WHEN 'signup' THEN 'Canceled' WHEN 'error' THEN 'Unused offer' ELSE 'Approved' END",
        "CODE_REJECT_REASON": f"CASE WHEN event_type = 'purchase' AND {e} % 3 = 0 THEN 'SCOFR' WHEN event_type = 'purchase' AND {e} % 3 = 1 THEN 'HC' ELSE 'XAP' END",
        "CNT_PAYMENT": _dbl(f"CASE WHEN {e} % 17 = 0 THEN NULL WHEN {e} % 7 = 0 THEN 0 ELSE ({e} * 5) % 72 END"),
        "AMT_APPLICATION": _dbl(f"CASE WHEN {e} % 11 = 0 THEN 0e0 ELSE {v} * 1e2 END"),
        "AMT_CREDIT": _dbl(f"CASE WHEN {e} % 13 = 0 THEN 0e0 ELSE {v} * 1e2 * (1e0 + ({e} % 8) * 7e-2) END"),
        "AMT_ANNUITY": _dbl(f"CASE WHEN {e} % 19 = 0 THEN NULL ELSE {v} * 8e0 END"),
        "NAME_CONTRACT_TYPE": _pick(f"{e} % 3", _text("Cash loans", "Consumer loans", "Revolving loans")),
        "RATE_DOWN_PAYMENT": _dbl(f"CASE WHEN {e} % 2 = 0 THEN NULL WHEN {e} % 71 = 1 THEN -45e-2 ELSE ({e} % 50) * 1e-2 END"),
        "AMT_DOWN_PAYMENT": _dbl(f"CASE WHEN {e} % 2 = 0 THEN NULL WHEN {e} % 71 = 1 THEN -9e-1 ELSE ({e} % 50) * 1e0 END"),
        "PRODUCT_COMBINATION": f"CASE WHEN {e} % 37 = 0 THEN NULL ELSE " + _pick(f"{e} % 6", _text("Cash Street: high", "POS household", "Cash X-Sell: low", "Card Street", "POS mobile", "Cash X-Sell: low")) + " END",
        "HOUR_APPR_PROCESS_START": _dbl(f"({e} * 5) % 24"),
        "NAME_TYPE_SUITE": f"CASE WHEN {e} % 3 = 1 THEN NULL ELSE 'Family' END",
        "NAME_CASH_LOAN_PURPOSE": f"CASE WHEN {e} % 9 = 0 THEN NULL WHEN {e} % 3 = 1 THEN 'XAP' WHEN {e} % 5 = 0 THEN 'XNA' ELSE " + _pick(f"{e} % 4", _text("Repairs", "Urgent needs", "Car repairs", "Medicine")) + " END",
        "SELLERPLACE_AREA": f"CASE WHEN {e} % 6 = 0 THEN -1 ELSE {e} % 100 END",
    }


def _spark(expr: str) -> str:
    return re.sub(r"DAYS_TO\((\w+), ('[\d-]+')\)", r"datediff(DATE \2, CAST(\1 AS DATE))", expr)


def _duck(expr: str) -> str:
    return re.sub(r"DAYS_TO\((\w+), ('[\d-]+')\)", r"date_diff('day', CAST(\1 AS DATE), DATE \2)", expr)


# -- Spark side --------------------------------------------------------------------------------


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(_spark(e)).alias(c) for c, e in columns.items()])


def application(spark: SparkSession, sf: str, spread: bool = False) -> DataFrame:
    """Main table from the customers, whose few columns are dealt by key first if a whole wide row is wanted of each."""
    rows = read(spark, sf, "customer")
    return _select(rows.repartition("c_custkey") if spread else rows, application_columns())


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Credit history from the orders."""
    return _select(read(spark, sf, "orders"), history_columns())


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Dense monthly panel of each order, as long as its lines say; some orders have no parent.

    An order becomes some twenty months after the shuffle, so the lines are dealt to a stated number of tasks: adaptive
    execution would join partitions by the size of the counts and give each task twenty times what it reckons with.
    """
    dealt = read(spark, sf, "lineitem").select("l_orderkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    lines = dealt.groupBy(F.col("l_orderkey").alias("o")).agg(F.count(F.lit(1)).alias("n_lines"))
    months = lines.withColumns({"last": F.expr(PANEL_LAST), "len": F.expr(PANEL_LENGTH)})
    rows = months.select("o", F.explode(F.expr("sequence(last, last + len - 1)")).alias("mm"))
    return rows.select(
        F.col("o").alias("SK_ID_BUREAU"), (-F.col("mm")).cast("int").alias("MONTHS_BALANCE"), F.expr(panel_status()).alias("STATUS")
    )


def previous(spark: SparkSession, sf: str) -> DataFrame:
    """Previous applications from the events."""
    return _select(read(spark, sf, "events"), previous_columns())


# -- DuckDB side -------------------------------------------------------------------------------


def _list(columns: dict[str, str]) -> str:
    return ", ".join(f"{_duck(e)} AS {c}" for c, e in columns.items())


def ctes() -> dict[str, str]:
    """Name -> DuckDB text of the raw tables."""
    return {
        "app_raw": f"SELECT {_list(application_columns())} FROM customer",
        "hist_raw": f"SELECT {_list(history_columns())} FROM orders",
        "panel_raw": (
            f"SELECT o AS SK_ID_BUREAU, -mm AS MONTHS_BALANCE, {panel_status()} AS STATUS FROM (SELECT o, unnest(range(last, last + len)) AS mm FROM ("
            f"SELECT o, {PANEL_LAST} AS last, {PANEL_LENGTH} AS len FROM (SELECT l_orderkey AS o, count(*) AS n_lines FROM lineitem GROUP BY 1)))"
        ),
        "prev_raw": f"SELECT {_list(previous_columns())} FROM events",
    }
