"""Aggregates kept as rows that add up: sketches and bitmaps by fine groups, merged to coarse ones without reading the rows again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct values of a HyperLogLog or theta sketch, and ranks of a KLL sketch, are off by less than these shares (three standard errors).
HLL_ERROR, THETA_ERROR, KLL_ERROR = 0.05, 0.05, 0.03


def sketched(df: DataFrame, by: list[str], item: str, value: str) -> DataFrame:
    """A row per group: n, and sketches of the distinct items (hll, theta) and of the values (kll). Nulls are in none of the sketches."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.hll_sketch_agg(item, 12).alias("hll"), F.theta_sketch_agg(item, 12).alias("theta"), F.kll_sketch_agg_double(F.col(value).cast("double"), 400).alias("kll"))


def merged_sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """The same of coarser groups."""
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", 12).alias("theta"), F.kll_merge_agg_double("kll").alias("kll"))


def in_common(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """on, common: about how many distinct items groups of two tables of sketches share."""
    a, b = left.select(*on, F.col("theta").alias("__a")), right.select(*on, F.col("theta").alias("__b"))
    return a.join(b, on).select(*on, F.theta_sketch_estimate(F.theta_intersection("__a", "__b")).alias("common"))


def bitmaps(df: DataFrame, by: list[str], item: str) -> DataFrame:
    """by, bucket, bits: which integers a group has, 32,768 to a bitmap; nulls are in none. What a task has seen is a bitmap before it is shuffled."""
    rows = df.where(F.col(item).isNotNull())
    return rows.groupBy(*by, F.bitmap_bucket_number(item).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(item)).alias("bits"))


def distinct_counts(maps: DataFrame, *groupings: list[str]) -> DataFrame:
    """Exact distinct counts for each of the groupings, from bitmaps by at least their columns: columns that a grouping lacks are null, grouping tells which it is."""
    every = list(dict.fromkeys(c for g in groupings for c in g))

    def one(k: int, g: list[str]) -> DataFrame:
        whole = maps.groupBy(*g, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        counted = whole.groupBy(*g).agg(F.sum(F.bitmap_count("bits")).alias("n"))
        return counted.select(*(F.col(c) if c in g else F.lit(None).cast(maps.schema[c].dataType).alias(c) for c in every), F.lit(k).alias("grouping"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))

    out = one(0, groupings[0])
    for k, g in enumerate(groupings[1:], 1):
        out = out.unionByName(one(k, g))
    return out


def close(estimate: Column, exact: Column, share: float) -> Column:
    return F.abs(estimate - exact) <= F.greatest(share * exact, F.lit(1.0))
