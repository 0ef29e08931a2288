"""Ranking, calibration, approval strategy and paired contrasts of scores.

A score is a risk: approving means keeping the lowest ones. Everything is read off one table of running
totals per distinct score, so ties are shared and no measure depends on row order. ``keys`` measures
many segments, folds or models in the same job.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom import params as P
from riskloom.functions import tails
from riskloom.functions.nullsafe import holds
from riskloom.operators.features import logit
from riskloom.operators.ranks import prefix_by_value, unique_ranks
from riskloom.operators.signals import bonferroni


def guard(df: DataFrame, y: str, score: str, probability: bool = False, keys: Iterable[str] = ()) -> None:
    """Fail unless y is 0/1 with both classes and the score is finite with three or more values."""
    s, t = F.col(score).cast("double"), F.col(y)
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    ends = df.groupBy(*keys).agg(
        F.count_if(F.coalesce(~t.isin(0, 1), F.lit(True))).alias("bad_y"),
        F.count_if(t == 1).alias("ones"),
        F.count_if(t == 0).alias("zeros"),
        F.count_if(~finite).alias("bad_score"),
        F.min(s).alias("lo"),
        F.max(s).alias("hi"),
    )
    rows = ends.collect()
    for r in rows:
        if r["bad_y"] or not r["ones"] or not r["zeros"]:
            raise ValueError("y must be 0 and 1 with both classes present")
        if r["bad_score"]:
            raise ValueError("score with missing or infinite values")
        if probability and (r["lo"] < 0 or r["hi"] > 1):
            raise ValueError("a probability must lie between 0 and 1")
    keys = list(keys)
    lo_hi = df.sparkSession.createDataFrame(rows, ends.schema).select(*keys, "lo", "hi") if keys else None
    if keys:
        between = df.join(lo_hi, keys).groupBy(*keys).agg(F.bool_or((s > F.col("lo")) & (s < F.col("hi"))).alias("m"))
        bad = between.filter(~F.col("m")).limit(1).count() > 0
    else:
        bad = bool(rows) and not df.agg(F.bool_or((s > rows[0]["lo"]) & (s < rows[0]["hi"])).alias("m")).first()["m"]
    if bad:
        raise ValueError("score with fewer than three distinct values: these look like labels")


def score_groups(df: DataFrame, y: str, score: str, keys: Iterable[str] = (), amount: str | None = None, weight: str | None = None) -> DataFrame:
    """Running totals per distinct score: rows, bads and optionally amounts; rows may be weighted."""
    w = F.col(weight) if weight else F.lit(1)
    bad = F.col(y).cast("double")
    sums = {"n": F.sum(w) if weight else F.count(F.lit(1)), "bads": F.sum(bad * w)}
    if amount:
        a = F.col(amount).cast("double")
        sums |= {"amt": F.sum(a * w), "bad_amt": F.sum(a * bad * w)}
    return prefix_by_value(df, score, keys, sums)


def _shape() -> dict[str, Column]:
    """The pieces of the ROC curve at each score group, thresholds going down."""
    n, bads = F.col("n"), F.col("bads")
    goods, cum_goods = n - bads, F.col("cum_n") - F.col("cum_bads")
    tot_b, tot_g = F.col("tot_bads"), F.col("tot_n") - F.col("tot_bads")
    return {
        "bads": bads,
        "goods": goods,
        "below_goods": cum_goods - goods,
        "tot_b": tot_b,
        "tot_g": tot_g,
        # above the group, then with it
        "fpr0": (tot_g - cum_goods) / tot_g,
        "fpr1": (tot_g - cum_goods + goods) / tot_g,
        "tpr0": (tot_b - F.col("cum_bads")) / tot_b,
        "tpr1": (tot_b - F.col("cum_bads") + bads) / tot_b,
        "n_above": F.col("tot_n") - F.col("cum_n") + n,
    }


def ranking(groups: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """AUC, Gini, KS, capture in the riskiest tenth and average precision."""
    s = _shape()
    auc = F.sum(s["bads"] * (s["below_goods"] + s["goods"] / 2)) / F.max(s["tot_b"] * s["tot_g"])
    ks = F.greatest(F.max(s["tpr1"] - s["fpr1"]), F.lit(0.0))
    kept = (1 - P.TOP_RISK_SHARE) * F.col("tot_n")
    approved_bads = F.sum(approved_part("bads", kept))
    precision = F.sum(s["bads"] / s["tot_b"] * (s["tpr1"] * s["tot_b"]) / s["n_above"])
    return groups.groupBy(*keys).agg(
        auc.alias("auc"),
        (2 * auc - 1).alias("gini"),
        ks.alias("ks"),
        (1 - approved_bads / F.max(s["tot_b"])).alias("top_capture"),
        precision.alias("avg_precision"),
    )


def approved_part(column: str, approved: Column) -> Column:
    """What a score group contributes to the ``approved`` lowest scores; a tie at the edge counts in part."""
    before = F.col("cum_n") - F.col("n")
    inside = F.least(F.greatest(approved - before, F.lit(0.0)), F.col("n").cast("double"))
    return F.col(column) * inside / F.col("n")


def strategy_curve(groups: DataFrame, keys: Iterable[str] = (), rates: Iterable[float] = P.APPROVAL_RATES) -> DataFrame:
    """Default rate among the approved, by count and by amount, at each approval rate."""
    keys, rates = list(keys), list(rates)
    parts = []
    for i, r in enumerate(rates):
        k = F.col("tot_n") * r
        parts += [
            F.sum(approved_part("bads", k)).alias(f"b{i}"),
            F.sum(approved_part("amt", k)).alias(f"a{i}"),
            F.sum(approved_part("bad_amt", k)).alias(f"x{i}"),
        ]
    totals = [F.max(f"tot_{c}").alias(f"tot_{c}") for c in ("n", "bads", "amt", "bad_amt")]
    wide = groups.groupBy(*keys).agg(*totals, *parts)
    cells = F.array(
        *[F.struct(F.lit(r).alias("rate"), F.col(f"b{i}").alias("b"), F.col(f"a{i}").alias("a"), F.col(f"x{i}").alias("x")) for i, r in enumerate(rates)]
    )
    long = wide.select(*keys, "tot_n", "tot_bads", "tot_amt", "tot_bad_amt", F.explode(cells).alias("c")).select("*", "c.*")
    by_count, by_amount = F.col("b") / (F.col("rate") * F.col("tot_n")), F.try_divide("x", "a")
    return long.select(
        *keys,
        "rate",
        by_count.alias("default_rate"),
        by_amount.alias("default_amount"),
        (by_count / (F.col("tot_bads") / F.col("tot_n")) - 1).alias("change_rate"),
        (by_amount / F.try_divide("tot_bad_amt", "tot_amt") - 1).alias("change_amount"),
    )


def partial_auc(groups: DataFrame, keys: Iterable[str] = (), max_fpr: float = P.PARTIAL_FPR) -> DataFrame:
    """Standardised area under the ROC curve up to a false-positive rate: 0.5 at random, 1 if perfect."""
    s = _shape()
    width = s["fpr1"] - s["fpr0"]
    inside = F.when(width > 0, F.least(F.greatest((max_fpr - s["fpr0"]) / width, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    reached = s["tpr0"] + (s["tpr1"] - s["tpr0"]) * inside
    area = F.sum(inside * width * (s["tpr0"] + reached) / 2)
    low, high = max_fpr * max_fpr / 2, max_fpr
    return groups.groupBy(*keys).agg((0.5 * (1 + (area - low) / (high - low))).alias("partial_auc"))


# -- calibration -------------------------------------------------------------------------------


def brier(y: str, p: str) -> Column:
    """Aggregate: mean squared error of a probability."""
    d = F.col(y).cast("double") - F.col(p)
    return F.avg(d * d)


def log_loss(y: str, p: str) -> Column:
    """Aggregate: mean log loss, probabilities kept one rounding step away from 0 and 1."""
    eps = 2.220446049250313e-16
    q = F.greatest(F.least(F.col(p).cast("double"), F.lit(1 - eps)), F.lit(eps))
    return -F.avg(F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)))


def calibration_errors(df: DataFrame, y: str, p: str, keys: Iterable[str] = ()) -> DataFrame:
    """Brier score and log loss."""
    return df.groupBy(*keys).agg(brier(y, p).alias("brier"), log_loss(y, p).alias("log_loss"))


#: A step of the intercept is cut to this length, so that a start far from the maximum comes back.
LONGEST_STEP = 4.0


class _Climb:
    """Newton steps on a concave likelihood, each halved until the loss falls; ``at`` is the point to look at next."""

    def __init__(self, start: list[float], tol: float, longest: float = math.inf):
        self.at, self.tol, self.longest = np.array(start), tol, longest
        self.step, self.least, self.last, self.done = np.zeros(len(start)), math.inf, False, False

    def look(self, loss: float, gradient: list[float], hessian: list[list[float]]) -> None:
        """Take loss, gradient and Hessian at ``at`` and move on."""
        if self.done:
            return
        if loss > self.least + 1e-12 * abs(self.least) and not self.last:  # too far: half the way back
            self.step /= 2
            self.at = self.at - self.step
            return
        self.least = min(loss, self.least)
        self.step = -np.linalg.solve(np.array(hessian), np.array(gradient))
        gain = float(-self.step @ np.array(gradient))
        if np.abs(self.step).max() > self.longest:
            self.step *= self.longest / np.abs(self.step).max()
        self.done = self.last or bool((np.abs(self.step) <= self.tol * (1 + np.abs(self.at))).all())
        # what is left to gain is rounding of the loss: one more whole step squares the distance
        self.last = gain <= 1e-13 * abs(self.least)
        self.at = self.at + self.step


def calibration_line(df: DataFrame, y: str, p: str, keys: Iterable[str] = (), tol: float = 1e-10, max_iter: int = 50) -> DataFrame:
    """Slope of a logistic of y on logit(p), and intercept with logit(p) as offset, per group of a few groups.

    Damped Newton steps over sums per key, on logits scaled by the group; each step is one aggregate over the distinct
    probabilities. ``fit`` says what has no finite value and comes back NULL: "one class" (both), "constant" or "separated"
    (the slope). Two classes that overlap have one finite maximum; running out of steps before it is an error.
    """
    keys = list(keys)
    spark = df.sparkSession
    per_p = (
        df.groupBy(*keys, logit(F.col(p)).alias("z"))
        .agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
        .persist()
    )
    z, n, s = F.col("z"), F.col("n"), F.col("s")
    try:
        good, bad = F.when(s < n, z), F.when(s > 0, z)
        spread = per_p.groupBy(*keys).agg(
            F.min(z).alias("z0"), F.max(z).alias("z1"), F.min(good).alias("g0"), F.max(good).alias("g1"), F.min(bad).alias("b0"), F.max(bad).alias("b1"),
            F.sum(n).alias("n"), F.sum(s).alias("s"), (F.sum(n * z) / F.sum(n)).alias("mean"),
        )
        lines, shifts, scales, fit = {}, {}, {}, {}
        for r in spread.collect():
            i = tuple(r[k] for k in keys)
            if r["g0"] is None or r["b0"] is None:
                fit[i] = "one class"
                continue
            shifts[i] = _Climb([0.0], tol, LONGEST_STEP)
            if r["z0"] == r["z1"]:
                fit[i] = "constant"
            elif r["g1"] <= r["b0"] or r["b1"] <= r["g0"]:
                fit[i] = "separated"
            else:
                fit[i] = "ok"
                scales[i] = (r["mean"], r["z1"] - r["z0"])
                lines[i] = _Climb([math.log(r["s"] / (r["n"] - r["s"])), 0.0], tol)

        def at(value: Mapping[tuple, float]) -> Column:
            if not keys:
                return F.lit(float(value.get((), 0.0)))
            return F.coalesce(*[F.when(_all_equal(keys, i), F.lit(float(v))) for i, v in value.items()], F.lit(0.0))

        for _ in range(max_iter):
            if all(c.done for c in (*lines.values(), *shifts.values())):
                break
            x = F.when(at({i: w for i, (_, w) in scales.items()}) > 0, (z - at({i: m for i, (m, _) in scales.items()})) / at({i: w for i, (_, w) in scales.items()})).otherwise(0.0)
            e, o = at({i: c.at[0] for i, c in lines.items()}) + at({i: c.at[1] for i, c in lines.items()}) * x, at({i: c.at[0] for i, c in shifts.items()}) + z
            mu, nu = _expit(e), _expit(o)
            w, u = n * mu * (1 - mu), n * nu * (1 - nu)
            rows = per_p.groupBy(*keys).agg(
                F.sum(_log_loss(e, n, s)).alias("line"),
                F.sum(n * mu - s).alias("g0"),
                F.sum((n * mu - s) * x).alias("g1"),
                F.sum(w).alias("h00"),
                F.sum(w * x).alias("h01"),
                F.sum(w * x * x).alias("h11"),
                F.sum(_log_loss(o, n, s)).alias("shift"),
                F.sum(n * nu - s).alias("k0"),
                F.sum(u).alias("k00"),
            ).collect()
            for r in rows:
                i = tuple(r[k] for k in keys)
                if i in lines:
                    lines[i].look(r["line"], [r["g0"], r["g1"]], [[r["h00"], r["h01"]], [r["h01"], r["h11"]]])
                if i in shifts:
                    shifts[i].look(r["shift"], [r["k0"]], [[r["k00"]]])
        else:
            if not all(c.done for c in (*lines.values(), *shifts.values())):
                raise RuntimeError(f"the calibration line has not settled after {max_iter} steps")
    finally:
        per_p.unpersist()
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys]
    ordered = [f.name for f in df.schema.fields if f.name in keys]
    rows = [
        tuple(dict(zip(keys, i))[k] for k in ordered) + (float(lines[i].at[1] / scales[i][1]) if i in lines else None, float(shifts[i].at[0]) if i in shifts else None, v)
        for i, v in fit.items()
    ]
    return spark.createDataFrame(rows, ", ".join([*fields, "slope double", "intercept double", "fit string"]))


def _log_loss(eta: Column, n: Column, s: Column) -> Column:
    """Negative log likelihood of ``s`` ones among ``n`` rows at log odds ``eta``."""
    return n * (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))) - s * eta


def _all_equal(keys: list[str], values: tuple) -> Column:
    out = F.lit(True)
    for k, v in zip(keys, values):
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def _expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def calibration_table(df: DataFrame, y: str, p: str, id_col: str, bins: int = 10, keys: Iterable[str] = ()) -> DataFrame:
    """Mean probability against observed rate in bins of equal size; ties split by id hash."""
    keys = list(keys)
    ranked = unique_ranks(df.select(*keys, id_col, y, p), p, id_col, keys)
    # right-closed bins of the ranks 1..n: how many inner edges 1 + j (n - 1) / bins lie below the rank
    below = F.call_function("div", (F.col("rank") - 1) * bins - 1, F.col("tot_n") - 1)
    index = F.least(F.greatest(below, F.lit(0)), F.lit(bins - 1)).cast("int")
    return ranked.groupBy(*keys, index.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("rate")
    )


def by_segment(df: DataFrame, segments: Mapping[str, Column], y: str, p: str, amount: str) -> dict[str, DataFrame]:
    """Ranking, strategy curve and calibration inside each named segment, all segments per job."""
    marks = F.filter(
        F.array(*[F.when(holds(m), F.lit(name)) for name, m in segments.items()]), lambda x: x.isNotNull()
    )
    rows = df.select(F.explode(marks).alias("segment"), y, p, amount)
    groups = score_groups(rows, y, p, ["segment"], amount)
    sizes = rows.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("bads"))
    return {
        "sizes": sizes,
        "ranking": ranking(groups, ["segment"]),
        "curve": strategy_curve(groups, ["segment"]),
        "errors": calibration_errors(rows, y, p, ["segment"]),
        "line": calibration_line(rows, y, p, ["segment"]),
    }


# -- paired contrasts --------------------------------------------------------------------------


def corrected_t(df: DataFrame, diff: str = "diff", keys: Iterable[str] = (), test_train_ratio: float = 0.25) -> DataFrame:
    """Resampled t of per-fold differences with the variance inflated for shared training rows."""
    g = df.groupBy(*keys).agg(F.count(diff).alias("n"), F.avg(diff).alias("mean"), F.var_samp(diff).alias("var"))
    mean, var = F.col("mean"), F.col("var")
    inf = F.lit(float("inf"))
    t = (
        F.when(var > 0, F.try_divide(mean, F.sqrt((1 / F.col("n") + test_train_ratio) * var)))
        .when(mean > 0, inf)
        .when(mean < 0, -inf)
        .otherwise(0.0)
    )
    return g.withColumn("t", t).withColumn("p", tails.p_student(F.col("t"), (F.col("n") - 1).cast("double"))).drop("var")


def delong(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """One row: both AUCs, their difference, its standard error and z.

    The component of a bad is the share of goods scored below it, and of a good the share of bads
    scored above it; both come with the running totals of the score.
    """
    pairs = df.select(F.col(y).alias("_y"), F.col(a).alias("_sa"), F.col(b).alias("_sb"))
    cells = pairs.groupBy("_y", "_sa", "_sb").agg(F.count(F.lit(1)).cast("double").alias("_w"))
    for side in ("a", "b"):
        name, bads = f"_s{side}", F.col("bads")
        goods = F.col("n") - bads
        parts = score_groups(pairs, "_y", name).select(
            name,
            ((F.col("cum_n") - F.col("cum_bads") - goods / 2) / (F.col("tot_n") - F.col("tot_bads"))).alias("_below"),
            (1 - (F.col("cum_bads") - bads / 2) / F.col("tot_bads")).alias("_above"),
        )
        own = F.when(F.col("_y") == 1, F.col("_below")).otherwise(F.col("_above"))
        cells = cells.join(parts, name).withColumn(f"_c{side}", own).drop("_below", "_above")
    w, ca, cb = F.col("_w"), F.col("_ca"), F.col("_cb")

    def over(cls: int, e: Column) -> Column:
        return F.sum(F.when(F.col("_y") == cls, w * e))

    s = cells.agg(
        *[
            x.alias(f"{k}{cls}")
            for cls in (1, 0)
            for k, x in {
                "m": over(cls, F.lit(1.0)),
                "a": over(cls, ca),
                "b": over(cls, cb),
                "d": over(cls, (ca - cb) * (ca - cb)),
            }.items()
        ]
    )

    def var(cls: int) -> Column:
        m, mean = F.col(f"m{cls}"), (F.col(f"a{cls}") - F.col(f"b{cls}")) / F.col(f"m{cls}")
        return (F.col(f"d{cls}") - m * mean * mean) / (m - 1) / m

    total = F.greatest(var(1) + var(0), F.lit(0.0))
    out = s.select(
        (F.col("a1") / F.col("m1")).alias("auc_a"), (F.col("b1") / F.col("m1")).alias("auc_b"), total.alias("var")
    ).withColumns({"diff": F.col("auc_a") - F.col("auc_b"), "se": F.sqrt("var")})
    flat = F.col("var") < 1e-18
    z = F.when(~flat, F.try_divide("diff", "se")).when(F.abs("diff") < 1e-12, 0.0).otherwise(F.signum("diff") * float("inf"))
    return out.withColumn("z", z).withColumn("p", tails.p_normal(F.col("z"))).drop("var")


def mcnemar(df: DataFrame, y: str, approve_a: str, approve_b: str) -> DataFrame:
    """One row: rows only A gets right, rows only B gets right, and the exact p."""
    good = F.col(y) == 0
    right_a, right_b = (F.col(approve_a) == 1) == good, (F.col(approve_b) == 1) == good
    g = df.agg(F.count_if(right_a & ~right_b).alias("b"), F.count_if(~right_a & right_b).alias("c"))
    return g.withColumn("p", tails.p_binomial(F.least("b", "c"), F.col("b") + F.col("c"), F.lit(0.5)))


def mcnemar_approved(df: DataFrame, y: str, approve_a: str, approve_b: str) -> DataFrame:
    """One row: clients only one model approves, the bads among them, and the exact p.

    The null share of the bads is the weight of A's group.
    """
    a, b = F.col(approve_a) == 1, F.col(approve_b) == 1
    bad = F.col(y) == 1
    g = df.agg(
        F.count_if(a & ~b).alias("only_a"),
        F.count_if(b & ~a).alias("only_b"),
        F.count_if(a & ~b & bad).alias("bads_a"),
        F.count_if(b & ~a & bad).alias("bads_b"),
    )
    share = F.coalesce(F.try_divide("only_a", F.col("only_a") + F.col("only_b")), F.lit(0.5)).cast("double")
    return g.withColumn("p", tails.p_binomial(F.col("bads_a"), F.col("bads_a") + F.col("bads_b"), share))


def contrast_strategies(per_fold: DataFrame, reference: str, family: Mapping[str, int] | None = None) -> DataFrame:
    """Each strategy against the reference on the same folds: AUC gained and zone arrears saved.

    ``per_fold`` has model, strategy, seed, k, auc and zone_rate. The family is a model and a metric;
    ``family`` optionally declares its size per model.
    """
    base = per_fold.filter(F.col("strategy") == reference).select("model", "seed", "k", F.col("auc").alias("auc0"), F.col("zone_rate").alias("zone0"))
    others = per_fold.filter(F.col("strategy") != reference)
    paired = others.join(base, ["model", "seed", "k"], "left")
    lost = F.raise_error(F.lit("a fold of the reference is missing")).cast("double")
    diffs = paired.select(
        "model",
        "strategy",
        F.explode(
            F.array(
                F.struct(F.lit("auc").alias("metric"), F.coalesce(F.col("auc") - F.col("auc0"), lost).alias("diff")),
                F.struct(F.lit("zone").alias("metric"), F.coalesce(F.col("zone0") - F.col("zone_rate"), lost).alias("diff")),
            )
        ).alias("d"),
    ).select("model", "strategy", "d.*")
    tests = corrected_t(diffs, "diff", ["model", "strategy", "metric"])
    adjusted = bonferroni(tests, ["model", "metric"])
    if family:
        size = F.coalesce(*[F.when(F.col("model") == m, F.lit(n)) for m, n in family.items()])
        wrong = F.raise_error(F.concat(F.lit("strategies missing for "), F.col("model"))).cast("double")
        adjusted = adjusted.withColumn("p_adjusted", F.when(F.col("family_size") == size, F.col("p_adjusted")).otherwise(wrong))
    return adjusted.groupBy("model", "strategy").pivot("metric", ["auc", "zone"]).agg(
        F.first("mean").alias("mean"), F.first("p_adjusted").alias("p")
    )


def constant_floor(fit: DataFrame, evaluate: DataFrame, y: str, keys: Iterable[str]) -> DataFrame:
    """Brier and log loss of the constant prevalence of the fitting part, per fold."""
    keys = list(keys)
    rate = fit.groupBy(*keys).agg(F.avg(F.col(y).cast("double")).alias("pd"))
    counts = evaluate.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_s"))
    share, pd_ = F.col("_s") / F.col("_n"), F.col("pd")
    return rate.join(counts, keys).select(
        *keys,
        "pd",
        (share * (1 - pd_) * (1 - pd_) + (1 - share) * pd_ * pd_).alias("brier"),
        (-(share * F.ln(pd_) + (1 - share) * F.ln(1 - pd_))).alias("log_loss"),
    )


def in_zone(curve: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """Mean default rate of the curve over the operating zone."""
    lo, hi = P.OPERATING_ZONE
    return curve.filter(F.col("rate").between(lo - 1e-9, hi + 1e-9)).groupBy(*keys).agg(F.avg("default_rate").alias("zone_rate"))
