"""Logistic regressions of many cells against single fits, and synthetic values between their parents."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as L
from riskloom.operators import splits as X
from riskloom.operators.logistic import Cells


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 300
    x = rng.normal(size=(n, 4)) * [1, 10, 1e5, 1] + [0, 3, 1e6, 7]
    x[:, 3] = 7  # a constant column has no coefficient
    y = rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] + 0.1 * x[:, 1] - 1)))
    return pd.DataFrame(x, columns=list("abcd")).assign(SK_ID_CURR=np.arange(n), TARGET=y.astype(int))


def gradient(pdf, fit, balanced, c=1.0):
    """The gradient at a fit, written out from its definition."""
    x = pdf[list("abcd")].to_numpy(float)
    y = pdf["TARGET"].to_numpy(float)
    z = (x - fit.mean) / fit.scale
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    r = w * (1 / (1 + np.exp(-(z @ fit.coefficients + fit.intercept))) - y)
    return np.append(z.T @ r + fit.coefficients / c, r.sum())


def test_cells_equal_single_fits(spark, frame):
    df = spark.createDataFrame(frame).repartition(40)
    folds = X.stratified_folds(df, (0, 1), 3)
    cells = Cells(df, "abcd", folds)
    fits = cells.fit(balanced=True)
    own = folds.toPandas()
    assert [(f.seed, f.fold) for f in fits] == [(s, k) for s in (0, 1) for k in range(3)]
    for f in fits:
        inside = frame.merge(own[(own["seed"] == f.seed) & (own["fold"] != f.fold)][["SK_ID_CURR"]])
        assert np.abs(gradient(inside, f, True)).max() < 1e-6 and f.coefficients[3] == 0
        assert np.allclose(f.mean[:3], inside[list("abc")].mean()) and np.allclose(f.scale[:3], inside[list("abc")].std())
    scored = cells.scores(fits).toPandas()
    assert len(scored) == len(frame) * 6
    held = scored[scored["held"]].merge(own, on=["SK_ID_CURR", "seed"])
    assert len(held) == len(frame) * 2 and (held["k"] == held["fold"]).all()
    raw, shift = fits[0].plain()
    one = scored[(scored["seed"] == 0) & (scored["k"] == 0)].set_index("SK_ID_CURR")["score"].sort_index()
    assert np.allclose(one, 1 / (1 + np.exp(-(frame[list("abcd")].to_numpy(float) @ raw + shift))))


def test_whole_fit_agrees_with_the_library(spark, frame):
    df = spark.createDataFrame(frame)
    fit = Cells(df, "abcd").fit()[0]
    theirs = L.fit_logistic(df, list("abcd")).stages[-1]
    assert np.allclose(fit.coefficients, theirs.coefficients.toArray(), atol=1e-4) and abs(fit.intercept - theirs.intercept) < 1e-4


def test_refusals(spark, frame):
    df = spark.createDataFrame(frame)
    with pytest.raises(ValueError, match="one class"):
        Cells(df.filter("TARGET = 1"), "abcd").fit()
    with pytest.raises(ValueError, match="without a fold"):
        Cells(df, "abcd", X.stratified_folds(df.filter("SK_ID_CURR > 5"), (0,), 3))
    with pytest.raises(Exception, match="missing values"):
        Cells(df.withColumn("a", F.when(F.col("SK_ID_CURR") > 3, F.col("a"))), "abcd").fit()
