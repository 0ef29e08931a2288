"""Registered queries against DuckDB on the smallest data; RISKLOOM_ALL=1 runs every one of them."""

import os
from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from riskloom.queries import standin as S

SF = "/root/testdata/sf0.001"
QUICK = (
    "C1_", "C4_", "C9_", "C11_", "C13_", "C14_", "C16_", "F5_", "F9_", "F12_", "G1_", "G2_", "G4_", "G5_", "G7_", "G10_", "J1_", "J3_", "J9_", "W6_", "W8_", "W11_", "W12_", "W13_",
    "AUD1_", "AUD13_", "AUD14_", "AUD19_", "AUD25_", "AUD30_", "M7_", "M9_", "M12_", "K3_", "X1_", "X2_", "X9_", "SNK8_",
)
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def names():
    every = oracle_sql()
    return sorted(every) if os.environ.get("RISKLOOM_ALL") else sorted(k for k in every if k.startswith(QUICK))


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    a, b = queries()[name](spark, SF).toPandas(), duck.execute(oracle_sql()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols, key=lambda s: s.astype(str)).reset_index(drop=True) for x in (a, b))
    for c in cols:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        assert same.all(), f"{name}.{c}: {a[c][~same].head().tolist()} against {b[c][~same].head().tolist()}"


def test_recency_strata_leave_out_unknown_recency(spark, tmp_path):
    """A client whose every decision day is unknown belongs to no stratum, not even to that of all clients."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    con.execute(f"CREATE TABLE events AS SELECT * FROM '{SF}/events.parquet' WHERE NOT (user_id = 2 AND event_id % 10 = 1)")
    con.execute("INSERT INTO events SELECT * REPLACE (997 * 1003 AS event_id, 2 AS user_id) FROM events LIMIT 1")
    for t in ("customer", "events"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    keys = ["reading", "counterpart", "stratum", "n"]
    got = queries()["M20_relative_recency"](spark, str(tmp_path)).select(keys).toPandas()
    want = con.execute(oracle_sql()["M20_relative_recency"]).df()[keys]
    assert set(map(tuple, got.to_numpy())) == set(map(tuple, want.to_numpy()))


def test_entry_is_lazy_and_stable(spark):
    df = entry(spark)
    assert "BUREAU_LOAN_COUNT" in df.columns and df.schema == entry(spark).schema


def test_labelled_months_are_hashed_by_credit(spark, duck):
    df = queries()["J12_inherit_target"](spark, SF)
    assert "ShuffledHashJoin" in df._jdf.queryExecution().sparkPlan().toString()
    rows = {r.STATUS: (r.n, r.rate) for r in df.collect()}
    want = duck.execute(oracle_sql()["J12_inherit_target"]).df()
    assert {k: v[0] for k, v in rows.items()} == dict(zip(want.STATUS, want.n))
    assert [rows[k][1] for k in want.STATUS] == pytest.approx(list(want.rate))


def test_months_are_dealt_to_a_stated_number_of_tasks(spark):
    """Twenty months come from each order after the shuffle; partitions joined by the size of the counts would hold twenty times that."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert S.panel(spark, SF).rdd.getNumPartitions() == 23
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
