"""Fitted stages, selection and persisted artefacts."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from riskloom.operators import cuts as Q
from riskloom.operators import selection as R
from riskloom.operators import stages as G
from riskloom.operators import splits as X
from riskloom.queries.base import CUTS
from riskloom.sources import artifacts as A
from riskloom.sources.tables import load_table
from helpers import history, panel, previous


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        (i, int(i % 7 == 0 or i % 11 == 0), float(i % 50) if i % 9 else None, "abc"[i % 3] if i % 10 else None, "x" if i % 2 else "y", 1.0, float((i * 37) % 101))
        for i in range(1, 801)
    ]
    return spark.createDataFrame(rows, "SK_ID_CURR bigint, TARGET int, n double, t string, b string, k double, r double").cache()


def test_winsor_is_fitted_on_train_only(table):
    train, rest = table.filter("SK_ID_CURR <= 400"), table.withColumn("n", F.col("n") * 10)
    m = G.Winsorizer(columns=["n"]).fit(train)
    assert m.fitted("limits") == G.Winsorizer(columns=["n"]).fit(train).fitted("limits") != G.Winsorizer(columns=["n"]).fit(rest).fitted("limits")
    assert m.transform(rest).agg(F.max("n")).first()[0] == m.fitted("limits")["n"]
    with pytest.raises(ValueError, match="missing"):
        m.transform(rest.drop("n"))


def test_encoders(table, spark):
    rare = G.RareGrouper(columns=["t", "b"], min_rows=100).fit(table)
    assert [r[:2] for r in rare.fitted("rows")] == [["t", None]] and rare.fitted("columns") == ["t"]
    hot = G.OneHot(columns=["t", "b"]).fit(table)
    assert hot.fitted("levels") == {"t": ["a", "b", "c", None], "b": ["x", "y"]}
    out = hot.transform(table.withColumn("t", F.lit("unseen")))
    assert out.agg(*[F.max(c) for c in ("t_a", "t_b", "t_c", "t_nan")]).first() == (0, 0, 0, 0) and "b_x" not in out.columns
    woe = G.WoeEncoder(columns=["t"]).fit(table)
    assert woe.transform(table.withColumn("t", F.lit("unseen"))).agg(F.max(F.abs("t_WOE"))).first()[0] == 0.0
    with pytest.raises(ValueError, match="target"):
        G.WoeEncoder(columns=["t"]).fit(table.drop("TARGET"))
    clash = table.withColumn("t", F.when(F.col("SK_ID_CURR") < 5, "q").otherwise("Other"))
    with pytest.raises(ValueError, match="Other"):
        G.RareGrouper(columns=["t"]).fit(clash)


def test_target_mean_leaves_out_the_own_fold(table):
    m = G.TargetMeanEncoder(columns=["t"], smoothing=10.0).fit(table)
    fold = G.fold_of("SK_ID_CURR", 5, 42)
    rows = m.transform_train(table).withColumn("f", fold).groupBy("f").agg(F.count_distinct("t").alias("levels")).collect()
    assert all(r["levels"] == 4 for r in rows)
    # changing the targets of a fold cannot change the encoding of its own rows
    flipped = table.withColumn("TARGET", F.when(fold == 0, 1 - F.col("TARGET")).otherwise(F.col("TARGET")))
    a = m.transform_train(table).filter(fold == 0).select("SK_ID_CURR", "t")
    b = G.TargetMeanEncoder(columns=["t"], smoothing=10.0).fit(flipped).transform_train(flipped).filter(fold == 0).select("SK_ID_CURR", "t")
    assert a.exceptAll(b).count() == 0


def test_many_levels_stay_a_table(table, monkeypatch):
    """A state that is a joined table encodes like one inside the model."""
    def run():
        rare = G.RareGrouper(columns=["t", "b"], min_rows=100).fit(table)
        woe, mean = G.WoeEncoder(columns=["t", "b"]).fit(table), G.TargetMeanEncoder(columns=["t"], smoothing=10.0).fit(table)
        seen = table.withColumn("t", F.when(F.col("SK_ID_CURR") == 7, "unseen").otherwise(F.col("t")))
        models = (rare, woe, mean)
        frames = [m.transform(seen) for m in models] + [mean.transform_train(seen), rare.report(table.sparkSession), woe.report(table.sparkSession)]
        rounded = [f.select(*[F.round(c, 12).alias(c) if t == "double" else F.col(c) for c, t in f.dtypes]) for f in frames]
        return models, [sorted(map(str, f.collect())) for f in rounded]

    inline, expected = run()
    monkeypatch.setattr(G, "INLINE_LEVELS", 0)
    joined, got = run()
    assert all(m.fitted("path") is None for m in inline) and all(m.fitted("path") for m in joined)
    assert got == expected
    with pytest.raises(ValueError, match="levels"):
        G.OneHot(columns=["t"]).fit(table)


def test_chain_saves_and_loads(table, tmp_path):
    chain = [G.Winsorizer(columns=["n"]), G.MedianImputer(columns=["n"]), G.RareGrouper(columns=["t"]), G.OneHot(columns=["t", "b"]), G.ConstantDropper()]
    fitted = Pipeline(stages=chain).fit(table)
    fitted.write().overwrite().save(str(tmp_path / "chain"))
    back = PipelineModel.load(str(tmp_path / "chain"))
    a, b = fitted.transform(table), back.transform(table)
    assert a.columns == b.columns and "k" not in a.columns and a.exceptAll(b).count() == 0


def test_selector_rules(table):
    good = table.withColumn("s", F.col("TARGET") * 5 + F.col("r") / 50).withColumn("s2", F.col("s") * 2)
    m = R.IvSelector(candidates={"s": None, "r": None, "s2": None}, protected=["n"], discards={"b": "frozen"}, redundant={"s2": ["s"]}).fit(good.drop("t").withColumn("b", F.lit(1)).fillna(0))
    assert set(m.fitted("motives")) >= {"b", "s2"} and "s" not in m.fitted("motives") and "n" not in m.fitted("motives")
    assert m.fitted("motives")["s2"] == "redundant with s"
    with pytest.raises(ValueError, match="'r': ..discard., .protected"):
        R.IvSelector(discards={"r": "x"}, protected=["r"]).fit(table)
    with pytest.raises(KeyError, match="nope"):
        R.IvSelector(candidates={"nope": None}).fit(table)
    with pytest.raises(ValueError, match="'r': ..loser., .no candidate"):
        R.IvSelector(candidates={"n": None}, redundant={"r": ["n"]}).fit(table)
    with pytest.raises(ValueError, match="'k': ..source., .protected"):
        R.IvSelector(candidates={"n": None}, protected=["k"], sources={"k": ["n"]}).fit(table)


def test_verdicts_follow_their_order(spark):
    iv = spark.createDataFrame([("a", 0.3), ("b", 0.001), ("la", 0.2), ("lb", 0.2), ("lc", 0.001), ("sa", 0.5), ("sb", 0.5), ("p", 0.0), ("d", 0.9)], "origin string, iv double")
    settings = {
        "candidates": {"a": None, "b": None, "la": None, "lb": None, "lc": None}, "protected": ["p"],
        "discards": {"d": "frozen", "sa": "presence", "sb": "presence"},
        "redundant": {"la": ["a", "b"], "lb": ["b"], "lc": ["b", "d"]}, "sources": {"sa": ["la", "lb"], "sb": ["la", "away"]},
    }
    rows = [(*r, r[2] != "away") for r in R.declared_roles(settings)]
    roles = spark.createDataFrame(rows, "origin string, role string, other string, there boolean")
    got = {r["origin"]: r["motive"] for r in R.verdicts(iv, roles, 0.02).collect()}
    assert got == {
        "a": None, "b": "IV 0.0010 below 0.0200", "d": "frozen", "p": None, "la": "redundant with a", "lb": None,
        "lc": "IV 0.0010 below 0.0200; no winner left", "sa": None, "sb": "presence; recovers nothing",
    }


def test_columns_of_an_origin():
    assert R.column_groups(["a", "x_1", "x_2", "a_b"]) == {"a": ["a"], "x": ["x_1", "x_2"], "x_1": ["x_1"], "x_2": ["x_2"], "a_b": ["a_b"]}


def test_first_crossing_can_fall_between_counts(spark):
    rows = [(2, 0)] * 90 + [(2, 1)] * 10 + [(5, 1)] * 20 + [(5, 0)] * 30
    clients = spark.createDataFrame(rows, "n int, TARGET int")
    assert Q.first_crossing(clients) == 3
    sweep = {r["cut"]: (r["marked"], r["chosen"]) for r in Q.cut_sweep(clients).collect()}
    assert sweep == {2: (150, 0), 3: (50, 1), 4: (50, 0), 5: (50, 0)}
    with pytest.raises(ValueError, match="crosses"):
        Q.first_crossing(clients.withColumn("TARGET", F.lit(0)))


def test_unsupported_cuts_are_unset_unless_strict(spark):
    rows = [{"SK_ID_CURR": i, "SK_ID_BUREAU": i, "DAYS_CREDIT_ENDDATE": -400.0} for i in range(20)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "SK_ID_CURR bigint, TARGET int")
    args = (history(spark, rows), panel(spark, {1: (0, "0")}), previous(spark, [{"SK_ID_CURR": i, "DAYS_DECISION": -9.0} for i in range(20)]))
    bridge = args[0].select("SK_ID_BUREAU", "SK_ID_CURR")
    with pytest.raises(ValueError, match="in the past"):
        Q.fit_auxiliary_cuts(*args, bridge, labels)
    found = Q.fit_auxiliary_cuts(*args, bridge, labels, strict=False)
    assert (found["bureau_enddate_tramo_min_anios"], found["bureau_enddate_tramo_max_anios"]) == (-2.0, 0.0)
    assert [found[c] for c in ("bureau_count_cola", "bb_many_credits_corte", "prev_count_cola", "prev_actividad_12m_cola", "prev_finalidades_urgentes")] == [None] * 5


def test_artifacts_guard_what_they_hold(spark, table, tmp_path):
    path = str(tmp_path / "split")
    split = A.write_split(table, path)
    with pytest.raises(FileExistsError):
        A.write_split(table, path)
    with pytest.raises(FileNotFoundError):
        A.read_split(spark, str(tmp_path / "none"))
    cuts = str(tmp_path / "cuts")
    with pytest.raises(ValueError, match="not fitted"):
        A.write_cuts({**CUTS, "bureau_count_cola": None}, split, cuts)
    A.write_cuts(CUTS, split, cuts)
    assert A.read_cuts(spark, split, cuts) == CUTS
    with pytest.raises(ValueError, match="another split"):
        A.read_cuts(spark, X.stratified_split(table, seed=9), cuts)
    with pytest.raises(FileNotFoundError):
        A.read_manifest(spark, str(tmp_path / "folds"), "x")
    with pytest.raises(ValueError, match="unknown table"):
        load_table(spark, "nothing", str(tmp_path))
