"""All registered queries."""

from __future__ import annotations

from riskloom.queries import audits, modelling, rows, signals  # noqa: F401  (registration)
from riskloom.queries.registry import QUERIES


def runs() -> dict:
    """Name -> Spark plan builder."""
    return {k: q.run for k, q in QUERIES.items()}


def texts() -> dict[str, str]:
    """Name -> DuckDB text, where SQL can say it."""
    return {k: q.sql for k, q in QUERIES.items() if q.sql is not None}
