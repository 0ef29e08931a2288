"""Hand-computed aggregates, null semantics and failing contracts."""

import pytest
from pyspark.sql import functions as F

from helpers import B_CUTS, H_CUTS, P_CUTS, by_key, history, panel, previous
from riskloom.operators import cleaning as C
from riskloom.operators import joins as J
from riskloom.operators import panel as B
from riskloom.operators import previous as V
from riskloom.operators.history import aggregate_history


@pytest.fixture(scope="module")
def hist(spark):
    rows = [
        # 1: the foreign row carries the only arrears
        {"SK_ID_CURR": 1, "SK_ID_BUREAU": 11},
        {"SK_ID_CURR": 1, "SK_ID_BUREAU": 12, "CREDIT_CURRENCY": "currency 2", "AMT_CREDIT_MAX_OVERDUE": 900.0, "AMT_ANNUITY": 0.0},
        # 2: annuity above its cap, no debt reported
        {"SK_ID_CURR": 2, "SK_ID_BUREAU": 21, "AMT_ANNUITY": 2e7, "AMT_CREDIT_SUM_DEBT": None},
        # 3: closed late, gross debt, end date in the counted range
        {"SK_ID_CURR": 3, "SK_ID_BUREAU": 31, "CREDIT_ACTIVE": "Closed", "DAYS_ENDDATE_FACT": 120.0},
        {"SK_ID_CURR": 3, "SK_ID_BUREAU": 32, "AMT_CREDIT_SUM_DEBT": 1e6, "DAYS_CREDIT_ENDDATE": 1000.0},
        {"SK_ID_CURR": 3, "SK_ID_BUREAU": 33, "CREDIT_TYPE": "Credit card", "DAYS_CREDIT_ENDDATE": 1000.0, "DAYS_CREDIT": -10.0},
        # 4: nothing usable
        {"SK_ID_CURR": 4, "SK_ID_BUREAU": 41, "CREDIT_CURRENCY": None, "DAYS_CREDIT_UPDATE": None, "DAYS_CREDIT_ENDDATE": -42000.0},
    ]
    return history(spark, rows)


def test_history_by_hand(hist):
    g = by_key(aggregate_history(hist, H_CUTS))
    assert (g[1]["BUREAU_LOAN_COUNT"], g[1]["BUREAU_HAS_ANY_OVERDUE"], g[1]["BUREAU_MAX_OVERDUE_EVER"]) == (2, 1, None)
    assert (g[1]["HAS_BUREAU_ANNUITY"], g[1]["BUREAU_CREDITS_WITH_ANNUITY_COUNT"], g[1]["BUREAU_HAS_FOREIGN_CURRENCY"]) == (1, 0, 1)
    assert g[1]["BUREAU_DEBT_CREDIT_RATIO"] == 0.5
    assert (g[2]["BUREAU_CREDITS_WITH_ANNUITY_COUNT"], g[2]["BUREAU_DEBT_CREDIT_RATIO"]) == (1, None)
    assert (g[3]["BUREAU_CLOSED_AFTER_ENDDATE"], g[3]["BUREAU_ENDDATE_2_5Y_COUNT"], g[3]["BUREAU_COUNT_COLA"]) == (1, 1, 1)
    assert g[3]["BUREAU_DEBT_CREDIT_RATIO"] == pytest.approx((50000 + 100000 + 50000) / 300000)
    assert g[3]["BUREAU_CREDITS_PER_YEAR"] == pytest.approx(3 / (1000 / 365.25))
    assert (g[4]["BUREAU_DAYS_CREDIT_UPDATE_FLAG"], g[4]["BUREAU_CURRENT_OVERDUE_SUM"], g[4]["BUREAU_DAYS_CREDIT_ENDDATE_MAX"]) == (None, None, None)


def test_history_is_local_idempotent_and_order_free(spark, hist):
    whole = by_key(aggregate_history(hist, H_CUTS))
    alone = by_key(aggregate_history(hist.filter("SK_ID_CURR = 3"), H_CUTS))
    assert alone[3] == whole[3]
    clean = C.clean_history(hist)
    assert by_key(aggregate_history(clean, H_CUTS)) == whole
    assert by_key(aggregate_history(hist.orderBy(F.desc("SK_ID_BUREAU")), H_CUTS)) == whole
    empty = aggregate_history(hist.limit(0), H_CUTS)
    assert empty.schema == aggregate_history(hist, H_CUTS).schema and empty.count() == 0


def test_history_contracts(hist):
    with pytest.raises(ValueError, match="CREDIT_TYPE"):
        aggregate_history(hist.drop("CREDIT_TYPE"), H_CUTS)
    with pytest.raises(KeyError, match="no_such_cut"):
        aggregate_history(hist, {**H_CUTS, "no_such_cut": 1})
    with pytest.raises(ValueError, match="bureau_count_cola"):
        aggregate_history(hist, {k: v for k, v in H_CUTS.items() if k != "bureau_count_cola"})


CREDITS = {
    8: (-5, "000000"),
    9: (-6, "0001000"),
    10: (-96, "333111"),
    11: (-5, "000002"),
    12: (-5, "111111"),
    13: (-5, "000CCC"),
    14: (-5, "XXX000"),
    15: (-20, "000000"),
    16: (-5, "0055CC"),
    17: (-1, "CX"),
}


def test_panel_by_hand(spark):
    g = by_key(B.aggregate_credits(panel(spark, CREDITS)), "SK_ID_BUREAU")
    code = {k: v["BB_CREDIT_TRAJECTORY"] for k, v in g.items()}
    names = {k: None if c is None else B.TRAJECTORIES[c] for k, c in code.items()}
    assert names == {8: "sin mora", 9: "mejora", 10: "mejora", 11: "empeora", 12: "estable", 13: None, 14: None, 15: "sin mora", 16: "estable", 17: None}
    assert (g[17]["BB_DPD_MONTHS"], g[17]["BB_WORST"], g[17]["BB_PCT_X"], g[17]["BB_LAST_STATUS"]) == (None, None, 0.5, "X")
    assert (g[16]["BB_LAST_STATUS"], g[16]["BB_LAST_DPD_MONTH"], g[16]["BB_PCT_DPD"]) == ("C", -2.0, 0.5)
    assert g[15]["BB_CENSORED"] == 1


def test_panel_clients(spark):
    bridge = spark.createDataFrame([(8, 1), (12, 1), (17, 2), (11, 3)], "SK_ID_BUREAU bigint, SK_ID_CURR bigint")
    g = by_key(B.aggregate_panel(panel(spark, CREDITS), bridge, B_CUTS))
    assert set(g) == {1, 2, 3}
    assert (g[1]["BB_N_CREDITS_WBAL"], g[1]["BB_TRAJECTORY"], g[1]["BB_CREDITS_WITH_DPD_COUNT"]) == (2, "estable", 1.0)
    blind = g[2]
    assert (blind["BB_ANY_DPD_FLAG"], blind["BB_CREDITS_WITH_DPD_COUNT"], blind["BB_DPD_MONTHS_COUNT"], blind["BB_PERSISTENT_DPD_FLAG"]) == (0, None, None, None)
    assert g[3]["BB_WORSENING_DPD_FLAG"] == 1.0 and g[3]["BB_RECENT_DPD_FLAG"] == 1


@pytest.mark.parametrize(
    "rows", [[(1, -3, "0"), (1, -1, "0")], [(1, -1, "0"), (1, -1, "1")], [(1, -3, "0"), (1, -1, "0"), (1, -1, "0")], [(None, -1, "0")], [(1, -1, "7")], [(1, -97, "0")], [(1, 1, "0")]]
)
def test_panel_contracts(spark, rows):
    bad = spark.createDataFrame(rows, "SK_ID_BUREAU bigint, MONTHS_BALANCE int, STATUS string")
    with pytest.raises(Exception, match="(?i)broken monthly window|panel|state"):
        B.aggregate_credits(bad).collect()


def test_bridge_contracts(spark):
    for rows in ([(1, 5), (1, 5)], [(None, 5)], [(2, None)]):
        with pytest.raises(Exception, match="bridge key"):
            B.credit_bridge(spark.createDataFrame(rows, "SK_ID_BUREAU bigint, SK_ID_CURR bigint")).collect()


def test_previous_by_hand(spark):
    rows = [
        {"SK_ID_CURR": 1, "DAYS_DECISION": -100.0, "NAME_CONTRACT_STATUS": "Refused", "CODE_REJECT_REASON": "SCOFR", "CNT_PAYMENT": 72.0},
        {"SK_ID_CURR": 1, "DAYS_DECISION": -400.0, "NAME_CLIENT_TYPE": "Repeater", "AMT_CREDIT": 120.0},
        {"SK_ID_CURR": 1, "DAYS_DECISION": -400.0, "PRODUCT_COMBINATION": None, "AMT_APPLICATION": 0.0, "NAME_CASH_LOAN_PURPOSE": "Repairs"},
        {"SK_ID_CURR": 2, "DAYS_DECISION": -365.0, "CNT_PAYMENT": None, "AMT_ANNUITY": None, "DAYS_LAST_DUE_1ST_VERSION": 365243.0},
        # the sentinel as an identifier
        {"SK_ID_CURR": 365243, "DAYS_DECISION": -50.0, "DAYS_LAST_DUE_1ST_VERSION": 500.0, "DAYS_LAST_DUE": 100.0, "RATE_DOWN_PAYMENT": -0.5, "NAME_CONTRACT_TYPE": "Consumer loans"},
    ]
    g = by_key(V.aggregate_previous(previous(spark, rows), P_CUTS))
    a, b, c = g[1], g[2], g[365243]
    assert (a["PREV_APPLICATION_COUNT"], a["PREV_COUNT_12M"], a["PREV_HISTORIAL_RECORTADO"], a["PREV_REFUSED_SCOFR_FLAG"]) == (3, 1, 1, 1)
    assert (a["PREV_REFUSED_LONG_TERM_FLAG"], a["PREV_OVERGRANTED_RATIO"], a["PREV_PHANTOM_FLAG"], a["PREV_STREET_RATIO"]) == (1, 0.5, 1, 0.0)
    assert a["PREV_URGENT_PURPOSE_RATIO"] == 1.0 and a["PREV_COUNT_COLA"] == 1
    assert (b["PREV_COUNT_12M"], b["PREV_CNT_PAYMENT_MEAN"], b["PREV_FUTURE_DUE_MAX"], b["PREV_EARLY_SETTLED_FLAG"]) == (0, None, None, None)
    assert b["PREV_APPLICATIONS_PER_YEAR"] == pytest.approx(1 / (365 / 365.25))
    assert (c["PREV_EARLY_SETTLED_FLAG"], c["PREV_FUTURE_DUE_MAX"], c["PREV_DOWN_PAYMENT_RATE_MEAN"]) == (1.0, 500.0, 0.0)
    with pytest.raises(Exception, match="unknown contract state"):
        V.aggregate_previous(previous(spark, [{"SK_ID_CURR": 1, "NAME_CONTRACT_STATUS": None}]), P_CUTS).collect()


def test_relative_recency_with_the_absolute_mask_equals_the_aggregate(spark):
    rows = [{"SK_ID_CURR": i % 3, "DAYS_DECISION": -40.0 * i - 1, "NAME_TYPE_SUITE": None if i % 2 else "Family", "HOUR_APPR_PROCESS_START": float(i)} for i in range(20)]
    prev = previous(spark, rows)
    agg = by_key(V.aggregate_previous(prev, P_CUTS))
    rel = by_key(V.relative_recency(prev, relative=False))
    assert {k: v["PREV_COUNT_12M_REL"] for k, v in rel.items()} == {k: float(v["PREV_COUNT_12M"]) for k, v in agg.items()}


def test_joins_keep_absence(spark, hist):
    clients = spark.createDataFrame([(1, 0), (9, 1)], "SK_ID_CURR bigint, TARGET int")
    joined = J.join_history(clients, aggregate_history(hist, H_CUTS))
    g = by_key(joined)
    assert (g[9]["HAS_BUREAU_HISTORY"], g[9]["BUREAU_LOAN_COUNT"], g[1]["HAS_BUREAU_HISTORY"]) == (0, None, 1)
    with pytest.raises(ValueError, match="before the panel"):
        J.join_panel(clients, clients)
    twice = hist.select("SK_ID_CURR", F.lit(1).alias("BUREAU_LOAN_COUNT"))
    with pytest.raises(ValueError, match="repeated"):
        J.join_history(clients, twice, check=True)


def test_main_table_cleaning(spark):
    rows = [(1, 0, "XNA", None, 365243.0, 9.0), (2, 1, "M", 5.0, -10.0, None), (3, 0, "F", 2.0, 365243.0, 1.0)]
    app = spark.createDataFrame(rows, "SK_ID_CURR bigint, TARGET int, CODE_GENDER string, AMT_ANNUITY double, DAYS_EMPLOYED double, AMT_REQ_CREDIT_BUREAU_DAY double")
    score = by_key(C.clean_application(app))
    assert len(score) == 3 and (score[1]["AMT_REQ_CREDIT_BUREAU_DAY"], score[2]["AMT_REQ_CREDIT_BUREAU_DAY"]) == (5.0, None)
    twice = by_key(C.sentinel_to_null(C.sentinel_to_null(app)))
    assert twice[3][C.ANOMALY_FLAG] == 1 and twice[3]["DAYS_EMPLOYED"] is None
    assert set(by_key(C.clean_training_application(app))) == {2, 3}
    with pytest.raises(ValueError, match="TARGET"):
        C.clean_training_application(app.drop("TARGET"))
    with pytest.raises(ValueError, match="1 rows outside"):
        C.require_domain(app, "CODE_GENDER", ~F.col("CODE_GENDER").isin("M", "F"), "main table")
