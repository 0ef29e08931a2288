"""Tail probabilities of the usual test statistics, vectorised for small result tables.

The statistics are computed by Spark aggregates; what reaches these functions is one row per test.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_sf(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x)."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * lead)
    # Lentz continued fraction
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return lead * h


def chi2_sf(x: float, dof: float) -> float:
    """P(chi2 > x)."""
    return gamma_q(dof / 2.0, x / 2.0)


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lead = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h / a


def student_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|)."""
    if math.isinf(t):
        return 0.0
    return beta_i(dof / 2.0, 0.5, dof / (dof + t * t))


def _first(holds, lo: int, hi: int) -> int:
    """Smallest index in [lo, hi] where a monotone predicate holds; hi + 1 if none."""
    hi += 1
    while lo < hi:
        mid = (lo + hi) // 2
        if holds(mid):
            hi = mid
        else:
            lo = mid + 1
    return lo


def _tail(log_pmf, start: int, stop: int, step: int) -> float:
    """Mass from ``start`` outwards, until the terms stop mattering."""
    total, i = 0.0, start
    while (i <= stop) if step > 0 else (i >= stop):
        term = math.exp(log_pmf(i))
        total += term
        if term <= total * 1e-18:
            break
        i += step
    return total


def _two_sided_mass(log_pmf, lo: int, hi: int, observed: int) -> float:
    """Mass of the outcomes not more likely than the observed one, for a unimodal law."""
    ref = log_pmf(observed) + math.log1p(1e-7)
    mode = _first(lambda i: i >= hi or log_pmf(i + 1) < log_pmf(i), lo, hi)
    left = _first(lambda i: log_pmf(i) > ref, lo, mode) - 1
    right = _first(lambda i: log_pmf(i) <= ref, mode, hi)
    if left >= right:
        return 1.0
    return min(1.0, _tail(log_pmf, left, lo, -1) + _tail(log_pmf, right, hi, 1))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact two-sided binomial test."""
    if n == 0:
        return 1.0
    if p in (0.0, 1.0):
        return 1.0 if k == n * p else 0.0

    def log_pmf(i: int) -> float:
        return (
            math.lgamma(n + 1)
            - math.lgamma(i + 1)
            - math.lgamma(n - i + 1)
            + i * math.log(p)
            + (n - i) * math.log1p(-p)
        )

    return _two_sided_mass(log_pmf, 0, n, k)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of the table [[a, b], [c, d]]."""
    row, col_, n = a + b, a + c, a + b + c + d
    if 0 in (row, n - row, col_, n - col_):
        return 1.0

    def log_choose(m: int, k: int) -> float:
        return math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1)

    def log_pmf(i: int) -> float:
        return log_choose(col_, i) + log_choose(n - col_, row - i) - log_choose(n, row)

    return _two_sided_mass(log_pmf, max(0, row + col_ - n), min(row, col_), a)


def _over(fn):
    """Apply a scalar function row by row of a small Arrow batch, missing in, missing out."""

    def run(*args: pd.Series) -> pd.Series:
        rows = zip(*[a.to_numpy() for a in args])
        return pd.Series(
            [math.nan if any(pd.isna(v) for v in r) else fn(*r) for r in rows], dtype="float64"
        )

    return run


@F.pandas_udf(T.DoubleType())
def p_normal(z: pd.Series) -> pd.Series:
    """Two-sided normal p of a z statistic."""
    return _over(lambda v: 2 * normal_sf(abs(v)))(z)


@F.pandas_udf(T.DoubleType())
def p_chi2(x: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of chi-square."""
    return _over(chi2_sf)(x, dof)


@F.pandas_udf(T.DoubleType())
def p_student(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided Student p."""
    return _over(student_two_sided)(t, dof)


@F.pandas_udf(T.DoubleType())
def p_binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    """Exact two-sided binomial p."""
    return _over(lambda i, m, q: binomial_two_sided(int(i), int(m), float(q)))(k, n, p)


@F.pandas_udf(T.DoubleType())
def p_fisher(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher p of a 2x2 table."""
    return _over(lambda *t: fisher_two_sided(*(int(v) for v in t)))(a, b, c, d)
