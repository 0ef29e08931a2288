"""Query registry: a Spark plan and, where SQL can say it, its DuckDB counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """One registered query."""

    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}
CTES: dict[str, str] = {}


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every number as a double rounded to the digits both engines agree on; arrays as text."""
    out = []
    for f in df.schema.fields:
        c = F.col("`" + f.name + "`")
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            c = F.round(c.cast("int").cast("double") if isinstance(f.dataType, T.BooleanType) else c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",", "")
        out.append(c.alias(f.name))
    return df.select(*out)


def cte(name: str, sql: str) -> None:
    """Declare a named piece of DuckDB text; pieces may use those declared before."""
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """The text preceded by every piece it uses, directly or not."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed) + " " + sql


def outer(sql: str, text: Iterable[str], digits: int) -> str:
    """Round the numbers of a result the way ``tidy`` does."""
    text = list(text)
    names = ", ".join(f'"{t}"' for t in text)
    numbers = f"round(CAST(COLUMNS(* EXCLUDE ({names})) AS DOUBLE), {digits}) + 0.0" if text else f"round(CAST(COLUMNS(*) AS DOUBLE), {digits}) + 0.0"
    head = f"{names}, {numbers}" if text else numbers
    return f"SELECT {head} FROM ({sql})"


def add(key: str, run: Run, sql: str | None = None, text: Iterable[str] = (), digits: int = 6, all_text: bool = False) -> None:
    """Register a query. ``text`` names the result columns that are not numbers."""
    if key in QUERIES:
        raise KeyError(f"query {key} registered twice")
    full = None
    if sql is not None:
        body = sql if all_text else outer(sql, text, digits)
        full = with_ctes(body)
    QUERIES[key] = Query(lambda spark, sf: tidy(run(spark, sf), digits), full)
