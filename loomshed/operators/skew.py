"""Joins and aggregates whose hot keys would end in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_join(large: DataFrame, other: DataFrame, on: str, salts: int, share: float = 0.01, unique: tuple[str, ...] = ()) -> DataFrame:
    """An inner join that deals the rows of `large` to `salts` tasks where their key holds `share` of all rows or more, and copies what `other` has of these keys to each.

    There are at most 1 / share such keys. A row's salt comes from its `unique` columns, so a task that is run again deals as before. Without them it is drawn by
    the row's place, which holds for inputs that come in the same order again; equal rows are dealt out too.
    """
    drawn = F.pmod(F.xxhash64(*unique), F.coalesce("__salts", F.lit(1))) if unique else F.floor(F.rand(7) * F.coalesce("__salts", F.lit(1)))
    hot = F.broadcast(heavy_hitters(large, on, share).select(on, F.lit(salts).alias("__salts")))
    dealt = large.join(hot, on, "left").withColumn("__salt", drawn.cast("int")).drop("__salts")
    copied = other.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copied, [on, "__salt"]).drop("__salt")


def distinct_per_group(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """count(distinct value) per key in two steps: a hot key's distinct values are found by many tasks."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.lit(1).alias("__one")).groupBy(*keys).agg(F.count("*").alias(name))


def heavy_hitters(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold at least this share of all rows, and how many."""
    counts: Column = F.count("*").alias("n")
    return df.groupBy(key).agg(counts).where(F.col("n") >= share * df.agg(counts).scalar())
