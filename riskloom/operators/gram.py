"""Pairwise-complete Pearson of many columns from one masked Gram matrix per partition."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.ranks import average_ranks

_SUMS = ("n", "x", "y", "xx", "yy", "xy")


def masked_gram(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(i, n, x, y, xx, yy, xy): for column i, arrays over j of the sums on rows with both present.

    Each task keeps one k x k block per sum whatever the number of rows, and emits k rows. Columns are
    first centred on their mean, which leaves the correlations unchanged and keeps the sums small.
    """
    columns = list(columns)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    narrow = df.select(
        *[(F.col(c).cast("double") - float(means[f"m{i}"] or 0.0)).alias(f"c{i}") for i, c in enumerate(columns)]
    )
    k = len(columns)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(_SUMS), k, k))
        seen = False
        for pdf in batches:
            if not len(pdf):
                continue
            seen = True
            v = pdf.to_numpy(dtype="float64")
            m = ~np.isnan(v)
            x, m = np.where(m, v, 0.0), m.astype("float64")
            sq = x * x
            total += np.stack([m.T @ m, x.T @ m, m.T @ x, sq.T @ m, m.T @ sq, x.T @ x])
        if seen:
            yield pd.DataFrame({"i": np.arange(k), **{s: list(total[a]) for a, s in enumerate(_SUMS)}})

    schema = "i int, " + ", ".join(f"{s} array<double>" for s in _SUMS)
    partial = narrow.mapInPandas(sums, schema)
    pairs = partial.select("i", F.posexplode(F.arrays_zip(*_SUMS)).alias("j", "s")).select("i", "j", "s.*")
    return pairs.filter(F.col("j") > F.col("i")).groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def pairwise_pearson(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(a, b, n, r) for every pair of columns, a before b in the given order."""
    columns = list(columns)
    names = F.array(*[F.lit(c) for c in columns])
    g = masked_gram(df, columns)
    r = pearson_from_sums(*[F.col(s) for s in _SUMS])
    return g.select(F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.col("n").cast("bigint").alias("n"), r.alias("r"))


def pearson_from_sums(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column) -> Column:
    """Correlation from sums; NULL when either side is constant."""
    vx, vy = xx - x * x / n, yy - y * y / n
    # what is left of a constant column is rounding, tiny against its sum of squares
    flat = (n < 2) | (vx <= xx * 1e-12) | (vy <= yy * 1e-12)
    return F.when(~flat, (xy - x * y / n) / F.sqrt(vx * vy))


def pearson(a: Column, b: Column, where: Column | None = None) -> Column:
    """Aggregate: pairwise-complete correlation; NULL when either side is constant."""
    both = a.isNotNull() & b.isNotNull()
    if where is not None:
        both = both & F.coalesce(where, F.lit(False))
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    spread = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return F.when(~flat, spread)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: rank correlation over the rows with both values."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("w"))
    weighted = both.join(_ranks_of(df, a, b, a, "ra"), a).join(
        _ranks_of(df, a, b, b, "rb"), b
    )
    w, x, y = F.col("w"), F.col("ra"), F.col("rb")
    s = weighted.agg(
        F.sum(w).alias("n"),
        F.sum(w * x).alias("x"),
        F.sum(w * y).alias("y"),
        F.sum(w * x * x).alias("xx"),
        F.sum(w * y * y).alias("yy"),
        F.sum(w * x * y).alias("xy"),
    )
    return s.select("n", pearson_from_sums(*[F.col(c) for c in _SUMS]).alias("rho"))


def _ranks_of(df: DataFrame, a: str, b: str, of: str, name: str) -> DataFrame:
    complete = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(of)
    return average_ranks(complete, of, name=name).select(of, name)
