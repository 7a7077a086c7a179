"""Subqueries that the planner would broadcast whatever their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(rows: DataFrame, column: str, others: DataFrame, other: str) -> DataFrame:
    """Rows whose `column` is NOT IN others' `other`, by SQL's rules for nulls, as a plain anti join.

    A null among the others leaves no row; a null in `column` is left out unless there are no others.
    """
    found = others.agg(F.count("*").alias("n"), F.count(other).alias("known")).first()
    if not found.n:
        return rows
    if found.known < found.n:
        return rows.limit(0)
    listed = others.select(F.col(other).alias("__other"))
    return rows.where(F.col(column).isNotNull()).join(listed, F.col(column) == F.col("__other"), "left_anti")
