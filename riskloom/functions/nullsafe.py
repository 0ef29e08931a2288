"""Null semantics used everywhere: "not reported", "reported zero" and "value" never mix.

A missing value is NULL (NaN is converted at the boundary), a comparison with it is not true, and an
aggregate over nothing stays NULL.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    """A column from a name or from itself."""
    return F.col(c) if isinstance(c, str) else c


def holds(predicate: Column) -> Column:
    """The predicate with "unknown" read as false."""
    return F.coalesce(predicate, F.lit(False))


def as_flag(predicate: Column) -> Column:
    """0/1 integer of a predicate, unknown read as 0."""
    return holds(predicate).cast("int")


def flag_where(predicate: Column, applies: Column) -> Column:
    """0.0/1.0 where the question applies, NULL elsewhere."""
    return F.when(holds(applies), holds(predicate).cast("double"))


def differs(c: str | Column, value) -> Column:
    """True when the column is not the value, missing included."""
    return ~col(c).eqNullSafe(F.lit(value))


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as double; NULL on a zero or missing denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def mean_of(predicate: Column) -> Column:
    """Share of rows (all of them) where the predicate holds."""
    return F.avg(holds(predicate).cast("double"))


def share_where(predicate: Column, applies: Column) -> Column:
    """Share of the rows where ``applies`` on which the predicate holds; NULL without any."""
    return F.avg(flag_where(predicate, applies))


def any_of(predicate: Column) -> Column:
    """1 when any row of the group satisfies the predicate."""
    return F.bool_or(holds(predicate)).cast("int")


def count_of(predicate: Column) -> Column:
    """Rows of the group that satisfy the predicate."""
    return F.count_if(holds(predicate))


def above_to_null(c: str, limit: float) -> Column:
    """The value, NULL above the limit."""
    return F.when(holds(F.col(c) > limit), None).otherwise(F.col(c))


def clip_upper(c: str | Column, limit: float) -> Column:
    """Cap from above, NULL kept (``least`` would skip it)."""
    c = col(c)
    return F.when(c > limit, F.lit(float(limit))).otherwise(c)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every floating NaN of the frame becomes NULL; other columns are untouched."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def require_columns(df: DataFrame, columns: Iterable[str], what: str) -> None:
    """Fail by name when the frame lacks a required column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")


def require_known(given: Iterable[str], known: Iterable[str], what: str) -> None:
    """Fail by name on an override nobody reads."""
    unknown = sorted(set(given) - set(known))
    if unknown:
        raise KeyError(f"{what}: unknown names {unknown}")


def as_double(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Cast the listed columns to double; a text amount fails at run time under ANSI mode."""
    return df.withColumns({c: F.col(c).cast("double") for c in columns})
