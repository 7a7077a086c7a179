"""Named queries, each with its equivalent in DuckDB's SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, folder) under its name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def load() -> None:
    """Import all modules that register queries."""
    from . import aggregates, filters, joins, python_functions, scalars, sets, storage, timed, tpch, windowed  # noqa: F401
