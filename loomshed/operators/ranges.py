"""Range joins through buckets, so that a shuffle on an equality replaces a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float, on: str | None = None) -> DataFrame:
    """Pairs with low <= at <= high (and equal `on`). Each range is dealt to the buckets of `width` that it touches; a
    point lies in one bucket, so every pair meets once. Choose the width near the usual length of a range."""
    bucket = lambda c: F.floor(F.col(c) / F.lit(width))
    p = points.withColumn("__bucket", bucket(at))
    r = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    keys = ["__bucket", *([on] if on else [])]
    return p.join(r, keys).where(F.col(at).between(F.col(low), F.col(high))).drop("__bucket")
