"""Bins: by quantile, by fixed edges and by value.

A bin assignment is a row expression over edges fitted beforehand, so applying it never shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import params as P
from riskloom.functions.nullsafe import holds
from riskloom.operators.ranks import exact_quantiles


@dataclass(frozen=True)
class Bins:
    """How one column is binned: by value, or by the inner edges of its quantiles."""

    column: str
    edges: tuple[float, ...] | None

    def label(self, c: Column | None = None) -> Column:
        """Text label of the row's bin; the missing value is a bin of its own."""
        c = F.col(self.column) if c is None else c
        if self.edges is None:
            return F.coalesce(c.cast("string"), F.lit(P.NULL_LEVEL))
        return F.when(c.isNull(), P.NULL_LEVEL).otherwise(bin_index(c, self.edges[1:-1]).cast("string"))


def bin_index(value: Column, inner: Iterable[float]) -> Column:
    """Zero-based right-closed bin: how many inner edges lie strictly below the value."""
    terms = [(value > float(e)).cast("int") for e in inner]
    return reduce(add, terms, F.lit(0))


def is_number(df: DataFrame, column: str) -> bool:
    """Numeric and not boolean."""
    return isinstance(df.schema[column].dataType, T.NumericType)


def numbers_of(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """The numeric columns of the list."""
    return [c for c in columns if is_number(df, c)]


def few_valued(df: DataFrame, columns: Iterable[str]) -> dict[str, bool]:
    """Whether each numeric column has at most two distinct values, in two narrow scans."""
    columns = list(columns)
    if not columns:
        return {}
    ends = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(columns)],
    ).first()
    inside = []
    for i, c in enumerate(columns):
        a, b = ends[f"a{i}"], ends[f"b{i}"]
        between = F.lit(False) if a is None else holds((F.col(c) > a) & (F.col(c) < b))
        inside.append(F.bool_or(between).alias(f"m{i}"))
    row = df.agg(*inside).first()
    return {c: not row[f"m{i}"] for i, c in enumerate(columns)}


def zero_one(df: DataFrame, columns: Iterable[str]) -> dict[str, bool]:
    """Whether every reported value of each column is 0 or 1."""
    columns = list(columns)
    if not columns:
        return {}
    row = df.agg(
        *[F.bool_and(F.coalesce(F.col(c).isin(0, 1), F.lit(True))).alias(f"z{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: bool(row[f"z{i}"]) for i, c in enumerate(columns)}


def distinct_edges(values: Iterable[float]) -> tuple[float, ...]:
    """Increasing edges without repeats: ties collapse bins instead of being split."""
    out: list[float] = []
    for v in values:
        if not out or v > out[-1]:
            out.append(v)
    return tuple(out)


def fit_bins(df: DataFrame, columns: Iterable[str], bins: int = P.MAX_BINS) -> dict[str, Bins]:
    """Bins of many columns: quantiles for numbers with more than two values, one per value otherwise.

    Each column is cut on its own reported values. A text column that really contains the key of the
    missing level fails.
    """
    columns = list(dict.fromkeys(columns))
    numbers = numbers_of(df, columns)
    texts = [c for c in columns if c not in numbers]
    if texts:
        hit = df.agg(*[F.bool_or(holds(F.col(c).cast("string") == P.NULL_LEVEL)).alias(c) for c in texts]).first()
        clash = [c for c in texts if hit[c]]
        if clash:
            raise ValueError(f"columns with a real {P.NULL_LEVEL!r} level: {clash}")
    few = few_valued(df, numbers)
    wide = [c for c in numbers if not few[c]]
    quantiles = exact_quantiles(df, wide, [i / bins for i in range(bins + 1)]) if wide else {}
    return {c: Bins(c, distinct_edges(quantiles[(c,)]) if (c,) in quantiles else None) for c in columns}


def fixed_bin(value: Column, edges: Iterable[float], labels: Iterable[str], lowest: bool = False) -> Column:
    """Label of the right-closed bin between consecutive edges; NULL outside them."""
    edges, labels = list(edges), list(labels)
    out = None
    for i, label in enumerate(labels):
        lo = value >= edges[i] if lowest and i == 0 else value > edges[i]
        cond = lo & (value <= edges[i + 1])
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def complete_bins(table: DataFrame, labels: Iterable[str], column: str = "bin", zero: Iterable[str] = ("n",)) -> DataFrame:
    """The table with one row for every declared bin, empty ones counted as zero."""
    spark = table.sparkSession
    wanted = spark.createDataFrame([(i, b) for i, b in enumerate(labels)], f"bin_order int, `{column}` string")
    return wanted.join(table, column, "left").fillna(0, subset=list(zero))


def labels_of(bins: Mapping[str, Bins], only: Iterable[str] | None = None) -> dict[str, Column]:
    """Column -> bin label expression."""
    return {c: b.label() for c, b in bins.items() if only is None or c in set(only)}
