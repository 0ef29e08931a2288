"""The pipeline's stages against brute force on a small table, and the registered SQL."""

from pathlib import Path

import pytest

import corpus_pipeline
from riskloom.llm import lines, mixing, queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == columns, name
        old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, after))
        assert new.keys() <= old.keys()
        if name == "line dedup":
            report = {r.doc_id: r.n_dropped for r in lines.line_report(before).collect()}
            assert all((new[i] != old[i]) == bool(n) for i, n in report.items() if (old[i] or "").strip())
        else:
            assert all(new[i] == old[i] for i in new)
        if name == "near duplicates":
            assert new.keys() == {r.component_id for r in simhash.report(before).collect()}
        if name == "mixing":
            plan = {r.doc_id: sum(2 * p.words >= r["size"] for p in r.passes) for r in mixing.planned(before).collect()}
            counts = {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()}
            assert counts == {i: n for i, n in plan.items() if n}
        before = after
    last = corpus_pipeline.encode(spark, before, SF)
    assert last.count() == before.count()


def test_stages_with_clashing_names(spark):
    names = ["__doc", "__rid", "__keep", "__n_dropped", "__n", "__tie", "__position", "__at", "__score", "__none", "__name", "a`b", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", *[f"doc_id AS `{n.replace('`', '``')}`" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        rows = after.collect()
        assert after.columns == docs.columns and rows and all(r[n] == r["doc_id"] for r in rows for n in names), name


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


@pytest.mark.parametrize("name", sorted(queries.texts()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    a, b = queries.runs()[name](spark, SF).toPandas(), con.execute(queries.texts()[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns) and len(a) == len(b)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c
