"""Sessions by gaps, over tables of any size: a lag, a running sum and an aggregate share one sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import bucket_of


def sessions(df: DataFrame, key: str, time: str, gap: str, bucket: str | None = None) -> DataFrame:
    """key, session (from 1), first, last, n: a session ends where the next row is more than `gap` away.

    bucket: an interval by which hot keys are dealt out; what each bucket finds is a row or a few, and is joined up afterwards.
    """
    rows = df.select(F.col(key).alias("__k"), F.col(time).alias("__first"), F.col(time).alias("__last"), F.lit(1).cast("bigint").alias("__n"), bucket_of(F.col(time), bucket).alias("__b"))
    if bucket is not None:
        rows = _joined_up(rows, ["__k", "__b"], gap)
    return _joined_up(rows, ["__k"], gap).select(F.col("__k").alias(key), F.col("__session").alias("session"), F.col("__first").alias("first"), F.col("__last").alias("last"), F.col("__n").alias("n"))


def _joined_up(rows: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Stretches (__first, __last, __n) of each key, with those at most `gap` apart made one."""
    w = Window.partitionBy(*keys).orderBy("__first")
    new = F.col("__first") > F.lag("__last").over(w) + F.expr(f"INTERVAL {gap}")
    numbered = rows.withColumn("__new", F.coalesce(new, F.lit(True)).cast("bigint")).withColumn("__session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__session").agg(F.min("__first").alias("__first"), F.max("__last").alias("__last"), F.sum("__n").alias("__n"))
