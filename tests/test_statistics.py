"""Kernels and statistics against brute force, with skew and ties."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.functions import tails as T
from riskloom.operators import binning as Bn
from riskloom.operators import evaluation as E
from riskloom.operators import resample as RS
from riskloom.operators import signals as M
from riskloom.operators import splits as X
from riskloom.operators import woe as W
from riskloom.operators.gram import pairwise_pearson
from riskloom.operators.ranks import _sketches, exact_quantiles, prefix_by_value, unique_ranks
from riskloom.session import checkpointed


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 3000
    v = np.round(rng.normal(size=n), 2)
    v[: n // 3] = 0.5  # one value holds a third of the rows
    y = (rng.random(n) < 0.1 + 0.1 * (v > 0.6)).astype(int)
    pdf = pd.DataFrame({"id": np.arange(n), "k": np.where(np.arange(n) % 3 == 0, "a", "b"), "v": v, "w": rng.normal(size=n) + v, "y": y, "amt": rng.integers(1, 100, n).astype(float)})
    pdf.loc[::17, "w"] = np.nan
    return pdf


@pytest.fixture(scope="module")
def df(spark, data):
    rows = data.astype(object).where(data.notna(), None)
    return spark.createDataFrame(rows.values.tolist(), "id bigint, k string, v double, w double, y int, amt double").cache()


def test_tail_probabilities():
    assert T.binomial_two_sided(2, 10, 0.5) == pytest.approx(0.109375)
    assert T.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0)
    assert T.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.034965, abs=1e-6)
    assert T.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert T.student_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert 2 * T.normal_sf(1.959963984540054) == pytest.approx(0.05)
    # huge counts stay cheap and close to the normal limit
    k, n = 500_030_000, 10**9
    z = (abs(k - n / 2) - 0.5) / math.sqrt(n / 4)
    assert T.binomial_two_sided(k, n, 0.5) == pytest.approx(2 * T.normal_sf(z), rel=1e-3)


def test_quantiles_match_numpy(df, data):
    probs = [0.0, 0.01, 0.1, 0.5, 0.73, 0.99, 1.0]
    got = exact_quantiles(df, ["v", "w", "amt"], probs)
    for c in ("v", "w", "amt"):
        assert got[(c,)] == pytest.approx(np.nanquantile(data[c], probs).tolist())
    grouped = exact_quantiles(df, ["w"], [0.5], ["k"])
    for k, g in data.groupby("k"):
        assert grouped[(k, "w")][0] == pytest.approx(np.nanquantile(g["w"], 0.5))


def test_sketches_of_many_columns_are_merged_by_several_tasks(spark):
    df = spark.range(0, 500, 1, 3).select(*[(F.col("id") * (i + 1)).alias(f"c{i}") for i in range(40)], F.lit(None).cast("double").alias("none"))
    spark.sparkContext.setJobGroup("sketches", "")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it joins the tasks of so few rows
    groups = _sketches(df, {c: F.col(c) for c in df.columns}, [], [0.5])
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("sketches") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("other", "")
    ((group, found),) = groups
    assert group == () and [s["n"] for s in found] == [500] * 40 + [0]
    assert [s["hi"] for s in found[:3]] == [499, 998, 1497]
    assert max((s for s in stages if s), key=lambda s: s.stageId).numTasks > 1
    got = exact_quantiles(df, df.columns, [0.5])
    assert [got[(f"c{i}",)][0] for i in range(40)] == [249.5 * (i + 1) for i in range(40)] and ("none",) not in got


@pytest.mark.parametrize("slices", [2, 5, 50])
def test_prefix_sums_do_not_depend_on_the_slices(df, data, slices):
    got = prefix_by_value(df, "v", ["k"], {"bads": F.sum("y")}, slices).toPandas().sort_values(["k", "v"]).reset_index(drop=True)
    exp = data.groupby(["k", "v"]).agg(n=("y", "size"), bads=("y", "sum")).reset_index()
    exp[["cum_n", "cum_bads"]] = exp.groupby("k")[["n", "bads"]].cumsum()
    assert got[["k", "v", "n", "bads", "cum_n", "cum_bads"]].values.tolist() == exp.values.tolist()


def test_unique_ranks_split_ties(df, data):
    r = unique_ranks(df.select("id", "v"), "v", "id").toPandas()
    assert sorted(r["rank"]) == list(range(1, len(data) + 1))
    assert r.sort_values("rank")["v"].is_monotonic_increasing


def auc(y, s):
    p, q = s[y == 1], s[y == 0]
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))


def approved(s, v, k):
    """Expected sum over the k lowest scores with random tie-breaking."""
    total, left = 0.0, k
    for u in np.unique(s):
        m = s == u
        take = min(left, m.sum())
        total += v[m].sum() * take / m.sum()
        left -= take
        if left <= 0:
            break
    return total


def test_ranking_and_curve(df, data):
    y, s, amt = data["y"].to_numpy(), data["v"].to_numpy(), data["amt"].to_numpy()
    g = E.score_groups(df, "y", "v", amount="amt")
    r = E.ranking(g).first()
    assert r["auc"] == pytest.approx(auc(y, s)) and r["gini"] == pytest.approx(2 * auc(y, s) - 1)
    cuts = np.unique(s)[::-1]
    tpr = np.array([0] + [(s[y == 1] >= c).mean() for c in cuts])
    fpr = np.array([0] + [(s[y == 0] >= c).mean() for c in cuts])
    assert r["ks"] == pytest.approx((tpr - fpr).max())
    prec = np.array([y[s >= c].mean() for c in cuts])
    assert r["avg_precision"] == pytest.approx((np.diff(tpr) * prec).sum())
    assert r["top_capture"] == pytest.approx(1 - approved(s, y, 0.9 * len(y)) / y.sum())
    grid = np.minimum(fpr, 0.3)
    area = np.trapezoid(np.interp(grid, fpr, tpr), grid) if hasattr(np, "trapezoid") else np.trapz(np.interp(grid, fpr, tpr), grid)
    # interpolation at a repeated fpr takes the upper point, so integrate the steps by hand
    area = sum((min(b, 0.3) - min(a, 0.3)) * (ta + (tb - ta) * ((min(b, 0.3) - a) / (b - a)) + ta) / 2 for a, b, ta, tb in zip(fpr, fpr[1:], tpr, tpr[1:]) if b > a and a < 0.3)
    assert E.partial_auc(g).first()[0] == pytest.approx(0.5 * (1 + (area - 0.045) / (0.3 - 0.045)))
    curve = {row["rate"]: row for row in E.strategy_curve(g).collect()}
    k = 0.8 * len(y)
    assert curve[0.8]["default_rate"] == pytest.approx(approved(s, y, k) / k)
    assert curve[0.8]["default_amount"] == pytest.approx(approved(s, y * amt, k) / approved(s, amt, k))


def test_delong_by_brute_force(df, data):
    d = data.dropna(subset=["w"])
    y = d["y"].to_numpy()
    comp = {}
    for c in ("v", "w"):
        s = d[c].to_numpy()
        m = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
        comp[c] = (m.mean(1), m.mean(0))
    diff = [comp["v"][i] - comp["w"][i] for i in (0, 1)]
    se = math.sqrt(diff[0].var(ddof=1) / len(diff[0]) + diff[1].var(ddof=1) / len(diff[1]))
    r = E.delong(df.filter("w IS NOT NULL"), "y", "v", "w").first()
    assert (r["auc_a"], r["diff"], r["se"]) == pytest.approx((comp["v"][0].mean(), diff[0].mean(), se))
    same = E.delong(df, "y", "v", "v").first()
    assert (same["z"], same["p"]) == (0.0, 1.0)


def test_calibration_line(df, data):
    p = 1 / (1 + np.exp(-(data["v"].to_numpy() - 2)))
    y = data["y"].to_numpy()
    z = np.log(p / (1 - p))
    b = np.zeros(2)
    a = np.c_[np.ones_like(z), z]
    for _ in range(50):
        mu = 1 / (1 + np.exp(-a @ b))
        b += np.linalg.solve((a * (mu * (1 - mu))[:, None]).T @ a, a.T @ (y - mu))
    c = 0.0
    for _ in range(50):
        mu = 1 / (1 + np.exp(-(z + c)))
        c += (y - mu).sum() / (mu * (1 - mu)).sum()
    withp = df.withColumn("p", 1 / (1 + F.exp(-(F.col("v") - 2))))
    got = E.calibration_line(withp, "y", "p").first()
    assert (got["slope"], got["intercept"]) == pytest.approx((b[1], c), abs=1e-7)
    table = E.calibration_table(withp, "y", "p", "id").toPandas()
    assert table["n"].max() - table["n"].min() <= 1 and table["n"].sum() == len(y)


def test_calibration_line_without_a_finite_slope(spark):
    rows = [("flat", y, 0.5) for y in (1, 1, 1, 0)] + [("apart", y, p) for y, p in ((0, 0.1), (0, 0.2), (1, 0.7), (1, 0.9))] + [("ones", 1, 0.3), ("ones", 1, 0.6)]
    rows += [("mixed", y, p) for y, p in ((0, 0.1), (1, 0.2), (0, 0.7), (1, 0.9))]
    got = {r["k"]: r for r in E.calibration_line(spark.createDataFrame(rows, "k string, y int, p double"), "y", "p", ["k"]).collect()}
    assert got["flat"]["intercept"] == pytest.approx(math.log(3)) and got["flat"]["slope"] is None and got["flat"]["fit"] == "constant"
    assert got["apart"]["slope"] is None and got["apart"]["fit"] == "separated" and got["apart"]["intercept"] is not None
    assert (got["ones"]["slope"], got["ones"]["intercept"], got["ones"]["fit"]) == (None, None, "one class")
    assert got["mixed"]["fit"] == "ok" and got["mixed"]["slope"] > 0


def test_calibration_line_of_overconfident_scores(spark):
    """Scores close to 0 and 1 that whole Newton steps from slope one do not bring to the maximum."""
    rng = np.random.default_rng(5)
    y = (rng.random(1200) < 0.08).astype(int)
    z = np.where(y == 1, rng.normal(0.5, 5, 1200), rng.normal(-11, 6, 1200))
    p = 1 / (1 + np.exp(-z))
    got = E.calibration_line(spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y int, p double"), "y", "p").first()
    c = np.clip(p, 1e-6, 1 - 1e-6)
    x = np.log(c / (1 - c))
    assert got["fit"] == "ok" and 0.05 < got["slope"] < 1
    # the gradients vanish: of the intercept with x as offset, and of the line at the slope found
    assert abs((1 / (1 + np.exp(-(x + got["intercept"]))) - y).sum()) < 1e-5
    a = 0.0
    for _ in range(200):
        m = 1 / (1 + np.exp(-(a + got["slope"] * x)))
        a -= max(-1, min(1, (m - y).sum() / (m * (1 - m)).sum()))
    assert abs(((1 / (1 + np.exp(-(a + got["slope"] * x))) - y) * x).sum()) < 1e-5


def test_guards(spark):
    def make(rows):
        return spark.createDataFrame(rows, "y int, s double")

    ok = [(0, 0.1), (1, 0.2), (0, 0.3)]
    E.guard(make(ok), "y", "s", True)
    for rows in ([(0, 0.1), (0, 0.2), (0, 0.3)], [(2, 0.1), (1, 0.2), (0, 0.3)], [(0, None), (1, 0.2), (0, 0.3)], [(0, float("inf")), (1, 0.2), (0, 0.3)], [(0, 0.1), (1, 0.2), (0, 0.2)], [(0, 1.5), (1, 0.2), (0, 0.3)]):
        with pytest.raises(ValueError):
            E.guard(make(rows), "y", "s", True)


def test_pearson_matrix(df, data):
    got = {(r["a"], r["b"]): r["r"] for r in pairwise_pearson(df.withColumn("c", F.lit(3.0)), ["v", "w", "amt", "c"]).collect()}
    c = data[["v", "w", "amt"]].corr()
    assert got[("v", "w")] == pytest.approx(c.loc["v", "w"]) and got[("w", "amt")] == pytest.approx(c.loc["w", "amt"])
    assert got[("v", "c")] is None


def test_evidence(df, data):
    alone = W.information_value(df, ["v"], "y").first()
    q = np.unique(np.quantile(data["v"], np.linspace(0, 1, 11)))
    b = pd.cut(data["v"], q, include_lowest=True)
    g = data.groupby(b, observed=True)["y"].agg(["sum", "count"])
    bads, n = g["sum"].sum(), g["count"].sum()
    prior = 20 * bads / n
    pb, pg = (g["sum"] + prior) / bads, (g["count"] - g["sum"] + 20 - prior) / (n - bads)
    assert alone["iv"] == pytest.approx(((pb - pg) * np.log(pb / pg)).sum())
    # a column says nothing inside its own values
    twin = W.conditional_iv(df.withColumn("flag", (F.col("v") > 0.6).cast("int")).withColumn("copy", F.col("flag")), [("flag", "copy")], "y").first()
    assert twin["iv"] == pytest.approx(0.0, abs=1e-9)
    with pytest.raises(ValueError, match="__NULO__"):
        Bn.fit_bins(df.withColumn("t", F.lit("__NULO__")), ["t"])


def test_signal_measures(df, data):
    r = M.rank_signal(df, M.measures(["w"]), "y").first()
    ok = data["w"].notna()
    assert r["effect"] == pytest.approx(abs(2 * auc(data["y"][ok].to_numpy(), data["w"][ok].to_numpy()) - 1)) and 0 <= r["p"] <= 1
    f = M.flag_signal(df.withColumn("f", (F.col("v") > 0.6).cast("int")), M.measures(["f"]), "y").first()
    hit = data["v"] > 0.6
    assert f["effect"] == pytest.approx((data["y"][hit].mean() - data["y"][~hit].mean()) * 100)
    with pytest.raises(Exception, match="3 tests declared"):
        M.bonferroni(df.select(F.lit(0.1).alias("p")).limit(2), declared=3).collect()


def test_split_and_folds(df, data):
    base = df.select(F.col("id").alias("SK_ID_CURR"), F.col("y").alias("TARGET"))
    s = X.stratified_split(base).toPandas()
    assert (s["split"] == "valid").sum() == math.ceil(0.2 * len(data))
    rate = s.groupby("split")["TARGET"].mean()
    assert abs(rate["train"] - rate["valid"]) < 1e-3
    again = X.stratified_split(base.repartition(7)).toPandas()
    assert s.sort_values("SK_ID_CURR")["split"].tolist() == again.sort_values("SK_ID_CURR")["split"].tolist()
    assert X.fingerprint(X.stratified_split(base)) != X.fingerprint(X.stratified_split(base, seed=1))
    f = X.stratified_folds(base, (0, 1), 5).toPandas()
    sizes = f.groupby(["seed", "fold", "TARGET"]).size().unstack()
    assert (sizes.max() - sizes.min() <= 1).all() and not f.duplicated(["seed", "SK_ID_CURR"]).any()
    assert X.undersample(base).groupBy("TARGET").count().select("count").distinct().count() == 1
    with pytest.raises(ValueError, match="unknown part"):
        X.only(base, "test", X.stratified_split(base))
    with pytest.raises(ValueError, match="repeated"):
        X.stratified_split(base.union(base))


def test_bootstrap_keeps_classes(df):
    base = df.select(F.col("id").alias("SK_ID_CURR"), F.col("y").alias("TARGET"), "v")
    w = X.bootstrap_weights(base, 5).join(base, "SK_ID_CURR").groupBy("replicate", "TARGET").agg(F.sum("weight").alias("n")).toPandas()
    assert (w.groupby("TARGET")["n"].nunique() == 1).all()
    ci = {r["name"]: r for r in X.bootstrap_interval(base, X.weighted_means({"mean": F.col("v")}), 50).collect()}
    assert ci["mean"]["lower"] < base.agg(F.avg("v")).first()[0] < ci["mean"]["upper"]


def test_bootstrap_sums_equal_the_statistic_over_drawn_rows(df):
    base = df.select(F.col("id").alias("SK_ID_CURR"), F.col("y").alias("TARGET"), F.when(F.col("id") % 7 > 0, F.col("v")).alias("v"))
    mean = X.weighted_means({"mean": F.col("v"), "rate": F.col("TARGET").cast("double")})
    for bucket_rows in (5, 1000):
        rows = X.bootstrap_rows(base, 30, bucket_rows=bucket_rows)
        direct = {(r["replicate"], r["name"]): r["value"] for r in mean(rows).collect()}
        sums = {(r["replicate"], r["name"]): r["value"] for r in X.bootstrap_means(base, mean, 30, bucket_rows=bucket_rows).collect()}
        assert direct.keys() == sums.keys() and all(abs(direct[k] - sums[k]) < 1e-9 for k in sums)
        sizes = {r["TARGET"]: r["count"] for r in base.groupBy("TARGET").count().collect()}
        drawn = rows.groupBy("replicate", "TARGET").agg(F.sum("weight").alias("n"), F.max("weight").alias("most")).collect()
        assert len(drawn) == 60 and all(r["n"] == sizes[r["TARGET"]] for r in drawn) and max(r["most"] for r in drawn) > 1


@pytest.mark.parametrize("way", ["pivots", "grid"])
def test_neighbours_stay_exact_in_small_batches(spark, monkeypatch, way):
    """Many coordinates, near ties and batches far smaller than a block; no query is sent to every cell as a row of its own on the grid."""
    rng = np.random.default_rng(8)
    x = np.round(rng.random((300, 50)), 1)
    x[:, 10:] = x[:, 10:] > 0.5
    x = np.unique(x, axis=0)
    monkeypatch.setattr(RS, "BATCH_ROWS", 7)
    monkeypatch.setattr(RS, "BLOCK_ROWS", 40)
    monkeypatch.setattr(RS, "GRID_ROWS", 90)
    if way == "pivots":
        monkeypatch.setattr(RS, "MANY_COORDINATES", 1000)
    pts = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "SK_ID_CURR bigint, v array<double>, mult bigint")
    got = RS.exact_neighbours(pts, "SK_ID_CURR", 5, block_rows=40).toPandas().sort_values(["SK_ID_CURR", "rk"])
    d = np.sqrt(np.einsum("ijk,ijk->ij", x[:, None] - x[None], x[:, None] - x[None]))
    np.fill_diagonal(d, np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :5]
    assert got["nb"].to_numpy().reshape(-1, 5).tolist() == want.tolist()


def test_exact_neighbours_with_duplicates(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 3))
    x[:80] = x[0]
    pdf = pd.DataFrame(x, columns=list("abc"))
    pdf["SK_ID_CURR"], pdf["TARGET"] = np.arange(240), (np.arange(240) % 5 == 0).astype(int)
    df = spark.createDataFrame(pdf)
    pts = df.withColumn("v", F.array("a", "b", "c")).groupBy("v").agg(F.min("SK_ID_CURR").alias("SK_ID_CURR"), F.count(F.lit(1)).alias("mult"))
    got = RS.exact_neighbours(pts, "SK_ID_CURR", 4, pivots=6, block_rows=25).toPandas()
    p = pts.toPandas().set_index("SK_ID_CURR").sort_index()
    v, ids = np.stack(p["v"].to_numpy()), p.index.to_numpy()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for i, k in enumerate(ids):
        assert got[got["SK_ID_CURR"] == k].sort_values("rk")["nb"].tolist() == ids[np.lexsort((ids, d[i]))[:4]].tolist()
    grown = RS.synthetic_minority(df, list("abc")).toPandas()
    assert grown["TARGET"].value_counts().nunique() == 1 and grown["SK_ID_CURR"].is_unique
    # every synthetic row lies between a minority row and one of its five nearest minority neighbours
    real = pdf[pdf["TARGET"] == 1][list("abc")].to_numpy()
    d = np.sqrt(((real[:, None] - real[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    pairs = [(i, j) for i in range(len(real)) for j in np.flatnonzero(d[i] <= np.sort(d[i])[4] + 1e-12)]
    a, b = (real[[p[i] for p in pairs]] for i in (0, 1))
    for v in grown[grown["SK_ID_CURR"] < 0][list("abc")].to_numpy():
        detour = np.linalg.norm(a - v, axis=1) + np.linalg.norm(b - v, axis=1) - np.linalg.norm(a - b, axis=1)
        assert detour.min() < 1e-9
    # brute force over the grown rows: the rows of every link go, and only they
    rows = grown.sort_values("SK_ID_CURR")
    v, y, ids = rows[list("abc")].to_numpy(), rows["TARGET"].to_numpy(), rows["SK_ID_CURR"].to_numpy()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    alone = (d == 0).sum(1) == 0
    near = d.argmin(1)
    linked = {ids[i] for i in range(len(ids)) if alone[i] and alone[near[i]] and near[near[i]] == i and y[i] != y[near[i]]}
    linked |= {ids[i] for i in range(len(ids)) if (d[i] == 0).sum() == 1 and y[near[i]] != y[i]}
    left = RS.synthetic_without_links(df, list("abc")).toPandas()
    assert set(left["SK_ID_CURR"]) == set(ids) - linked


def test_links_of_many_coordinates_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # whole coordinates give ties; the blend lies between rows as synthetic ones do; wide values are met by single precision
    x = rng.integers(0, 2, size=(500, 150)).astype(float) * rng.random(150)
    x[300:400] = (x[:100] + 0.1 * (x[100:200] - x[:100])).round(3)
    x[400:420], x[420:440] = x[:20], x[20:40]
    x[440:460] = x[20:40]
    y = rng.integers(0, 2, 500)
    for scale, shift in ((1.0, 0.0), (1e5, 1e6)):
        v = x * scale + shift
        pdf = pd.DataFrame(v, columns=[f"c{i}" for i in range(150)]).assign(SK_ID_CURR=np.arange(500) - 250, TARGET=y)
        df = spark.createDataFrame(pdf)
        points = df.withColumn("v", F.array(*[f"c{i}" for i in range(150)])).groupBy("v").agg(F.min("SK_ID_CURR").alias("SK_ID_CURR"), F.count(F.lit(1)).alias("mult"), F.min("TARGET").alias("lo"))
        points = checkpointed(points.select("SK_ID_CURR", "v", F.when(F.col("mult") == 1, F.col("lo").cast("string")).alias("cls")))
        p = points.toPandas().sort_values("SK_ID_CURR").reset_index(drop=True)
        q = np.stack(p["v"].to_numpy())
        d = np.sqrt(np.stack([np.einsum("ij,ij->i", a - q, a - q) for a in q]))
        np.fill_diagonal(d, np.inf)
        near, cls, ids = d.argmin(axis=1), p["cls"], p["SK_ID_CURR"]
        want = {ids[i] for i in range(len(p)) if near[near[i]] == i and cls[i] and cls[near[i]] and cls[i] != cls[near[i]]}
        assert len(want) > 10
        for region_rows in (60, 1000):
            got = [r[0] for r in RS.links_of_many(points, "SK_ID_CURR", region_rows).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    # the whole operator, with the twins of opposite classes
    names, linked = [f"c{i}" for i in range(150)], set(want)
    for _, own in pdf.groupby(names):
        if len(own) == 2 and own["TARGET"].nunique() == 2:
            linked |= set(own["SK_ID_CURR"])
    assert len(linked) > len(want)
    for few in (RS.FEW_POINTS, 0):
        monkeypatch.setattr(RS, "FEW_POINTS", few)
        assert {r[0] for r in RS.tomek_links(df, names).collect()} == linked


def test_grid_of_many_coordinates_shuffles_each_point_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.random((600, 100))
    pts = checkpointed(spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id bigint, v array<double>, mult bigint"))
    monkeypatch.setattr(RS, "GRID_ROWS", 50)

    def written() -> int:
        return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = written()
    got = RS.exact_neighbours(pts, "id", 1).toPandas().sort_values("id")
    assert written() - before < 3 * x.nbytes
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    assert got["nb"].tolist() == d.argmin(axis=1).tolist()


def test_two_level_edges_count_like_one(spark):
    from riskloom.operators.ranks import _edges_below

    for n in (1, 64, 65, 70, 255, 1000):
        edges = sorted(float(i * i % 97) for i in range(n))
        t = spark.createDataFrame([(edges, float(v)) for v in (-1, 0, 1, 48.5, 96, 200)], "e array<double>, v double")
        got = t.select("e", "v", _edges_below(F.col("e"), F.col("v"), n).alias("k")).collect()
        assert [r["k"] for r in got] == [sum(x < r["v"] for x in edges) for r in got]


def test_quantiles_by_group_with_a_hot_group_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(round(v, 1))) for v in rng.normal(0, 3, 4000)] + [("one", 7.0)] + [("far", float(v)) for v in rng.normal(1e6, 1e5, 500)] + [("flat", 2.0)] * 30 + [("none", None)]
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["v"], probs, ["g"])
    for g in ("hot", "one", "far", "flat"):
        assert got[(g, "v")] == pytest.approx(np.quantile([v for k, v in rows if k == g], probs).tolist())
    assert ("none", "v") not in got
