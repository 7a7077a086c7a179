"""Exact percentiles of groups of any size: by selection where a group is large, so that no task holds its values.

Values of a large group are counted by buckets between its least and its greatest. The bucket that holds a wanted rank is the
next interval, from its own least to its own greatest value, and only its rows go on. When what is left of an interval is small, it is sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: Bytes of a table that is sent to all tasks, at most; and of a row of the large groups' table.
MOST_SENT, ROW = 32 << 20, 128


def _bucket(buckets: int, by_size: bool) -> Column:
    """Of __v between __lo and __hi: by equal steps, or by equal steps of the logarithm, for values of very different sizes.

    The ends have buckets of their own, so each step leaves fewer different values. Halves can't overflow."""
    scaled = (lambda c: F.signum(c) * F.greatest(F.log(F.abs(c)) + 746, F.lit(0.0))) if by_size else (lambda c: F.col(c) / 2)
    share = (scaled("__v") - scaled("__lo")) / (scaled("__hi") - scaled("__lo"))
    inner = F.floor(F.nanvl(share, F.lit(0.0)) * (buckets - 2)).cast("int") + 1
    return F.when(F.col("__v") == F.col("__lo"), 0).when(F.col("__v") == F.col("__hi"), buckets - 1).otherwise(F.least(F.greatest(inner, F.lit(1)), F.lit(buckets - 2)))


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows * ROW <= MOST_SENT else df


def exact_percentiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], large: int = 1_000_000, buckets: int = 4096) -> DataFrame:
    """keys and a column for each of `wanted` (name -> share): the interpolated percentile of the value, as a double.

    Nulls and NaN aren't counted; a group of nothing else has null results. A null key is a key, no keys are one group. Groups of up to `large`
    values are sorted in one task each. An empty table gives no row.
    """
    if not keys:
        return exact_percentiles(df.withColumn("__all", F.lit(0)), ["__all"], value, wanted, large, buckets).drop("__all")
    v = F.col(value).cast("double")
    rows = df.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.when(~F.isnan(v), v).alias("__v"))
    names = [f"__k{i}" for i in range(len(keys))]
    groups = written(rows.groupBy(*names).agg(F.count("__v").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")).withColumn("__id", F.monotonically_increasing_id()), "groups")
    named = lambda d: d.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), *wanted)
    hot = groups.where(F.col("__n") > large)
    n_hot = hot.count()
    same = [F.col(n).eqNullSafe(F.col(f"__g{n}")) for n in names]
    keyed = _sent(hot.withColumnsRenamed({n: f"__g{n}" for n in names}), n_hot)
    others = rows.join(keyed, same, "left_anti") if n_hot else rows
    all_of = F.percentile("__v", F.array(*map(F.lit, wanted.values())))
    plain = others.groupBy(*names).agg(all_of.alias("__p")).select(*names, *(F.get("__p", F.lit(k)).alias(c) for k, c in enumerate(wanted)))
    if not n_hot:
        return named(plain)

    place = lambda p: F.lit(float(p)) * (F.col("__n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*(F.array(*(f(place(p)).cast("bigint") for f in (F.floor, F.ceil))) for p in wanted.values()))))
    targets = hot.select("__id", F.explode(ranks).alias("__rank"), "__lo", "__hi", F.lit(0).cast("bigint").alias("__below"), F.col("__n").alias("__left"))
    values = rows.where("__v is not null").join(keyed, same).select("__id", "__lo", "__hi", "__v")
    by_size = False
    while targets.where((F.col("__left") > large) & (F.col("__lo") < F.col("__hi"))).count():
        counted = values.withColumn("__b", _bucket(buckets, by_size)).groupBy("__id", "__lo", "__hi", "__b").agg(F.count("*").alias("__c"), F.min("__v").alias("__a"), F.max("__v").alias("__z"))
        # as many rows as buckets for each rank
        upto = Window.partitionBy("__id", "__rank").orderBy("__b")
        ends = targets.join(counted, ["__id", "__lo", "__hi"]).withColumn("__end", F.col("__below") + F.sum("__c").over(upto))
        held = written(ends.where((F.col("__rank") < F.col("__end")) & (F.col("__rank") >= F.col("__end") - F.col("__c"))), "held")
        steps = held.select("__id", "__lo", "__hi", "__b", "__a", "__z").distinct()
        values = values.withColumn("__b", _bucket(buckets, by_size)).join(_sent(steps, 2 * n_hot * len(wanted)), ["__id", "__lo", "__hi", "__b"])
        values = written(values.select("__id", F.col("__a").alias("__lo"), F.col("__z").alias("__hi"), "__v"), "values")
        targets = held.select("__id", "__rank", F.col("__a").alias("__lo"), F.col("__z").alias("__hi"), (F.col("__end") - F.col("__c")).alias("__below"), F.col("__c").alias("__left"))
        by_size = not by_size
    known = targets.where("__lo = __hi").select("__id", "__rank", F.col("__lo").alias("__v"))
    left = values.join(targets.where("__lo < __hi"), ["__id", "__lo", "__hi"]).withColumn("__k", F.row_number().over(Window.partitionBy("__id", "__rank").orderBy("__v")))
    found = known.unionByName(left.where("__below + __k = __rank + 1").select("__id", "__rank", "__v"))
    by_rank = found.groupBy("__id").agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__m")).join(hot, "__id")
    at = lambda p, f: F.element_at("__m", f(place(p)).cast("bigint"))
    between = lambda p: F.when(F.floor(place(p)) == F.ceil(place(p)), at(p, F.floor)).otherwise((F.ceil(place(p)) - place(p)) * at(p, F.floor) + (place(p) - F.floor(place(p))) * at(p, F.ceil))
    return named(plain.unionByName(by_rank.select(*names, *(between(p).alias(c) for c, p in wanted.items()))))
