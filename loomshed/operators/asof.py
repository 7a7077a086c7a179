"""As-of joins: each left row with the nearest right row in time, per key.

Both sides are put in one table, ordered by key and time, and the last (or next) right row is carried along: one
shuffle on the key and one sort, however many rows match a time range. Long keys cost a sort, not a product. With a bucket
width the rows of keys that hold a hundredth of all rows or more are dealt out by time too, and each bucket gets the last right row before it (the next
after it) from a table of one row per bucket: no task holds a hot key. Left rows without a key match nothing and go past all that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import heavy_hitters


#: Share of all rows from which on a key is dealt out.
HEAVY = 0.01


def bucket_of(time: Column, width: str | None) -> Column:
    """The number of the stretch of `width` (an interval such as "1 day") that a time lies in."""
    if width is None:
        return F.lit(0).cast("bigint")
    return F.floor(F.unix_micros(time.cast("timestamp")) / F.unix_micros(F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {width}"))).cast("bigint")


def _carried(rows: DataFrame, name: str, forward: bool, dealt: bool) -> DataFrame:
    """rows with `name`: the last right row at or before each row (forward: the first at or after)."""
    turned = (lambda c: c.desc()) if forward else (lambda c: c.asc())
    within = Window.partitionBy("__k", "__b").orderBy(turned(F.col("__t")), "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.last("__r", ignorenulls=True).over(within)
    if not dealt:
        return rows.withColumn(name, near)
    # of each bucket the right row that its neighbour needs; of rows of one time the greatest __tie wins, either way
    edge = F.max_by if not forward else F.min_by
    hot = rows.where("__b is not null")
    best = hot.where("__side = 0").groupBy("__k", "__b", "__t").agg(F.max_by("__r", "__tie").alias("__r")).groupBy("__k", "__b").agg(edge("__r", "__t").alias("__edge"))
    across = Window.partitionBy("__k").orderBy(turned(F.col("__b"))).rowsBetween(Window.unboundedPreceding, -1)
    buckets = hot.select("__k", "__b").distinct().join(best, ["__k", "__b"], "left").withColumn("__before", F.last("__edge", ignorenulls=True).over(across)).where("__before is not null")
    joined = rows.withColumn(name, near).join(buckets.drop("__edge"), ["__k", "__b"], "left")
    return joined.withColumn(name, F.coalesce(name, "__before")).drop("__before")


def asof_join(left: DataFrame, right: DataFrame, on: str, time: str, direction: str = "backward", tolerance: str | None = None, tie: str | None = None, prefix: str = "right_", bucket: str | None = None) -> DataFrame:
    """All left rows, and the right side's columns under `prefix` (null where nothing matches).

    direction: backward takes the last right row at or before the left one, forward the first at or after, nearest the closer
    of both (backward on ties). tolerance: an interval such as "1 hour" that the distance may not exceed. tie: a right
    column that decides between right rows of one time; the greatest wins. bucket: an interval by which hot keys are dealt out.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"direction is {direction!r}")
    keys = [r[0] for r in heavy_hitters(left.select(on).unionAll(right.select(on)).where(F.col(on).isNotNull()), on, HEAVY).collect()] if bucket else []  # 1 / HEAVY at most
    mine = F.struct(*left.columns)
    theirs = F.struct(*(F.col(c).alias(prefix + c) for c in right.columns))
    rows = left.where(F.col(on).isNotNull()).select(F.col(on).alias("__k"), F.col(time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).alias("__tie"), mine.alias("__l"), F.lit(None).alias("__r")).unionByName(
        right.where(F.col(on).isNotNull()).select(F.col(on).alias("__k"), F.col(time).alias("__t"), F.lit(0).alias("__side"), F.col(tie or time).alias("__tie"), F.lit(None).alias("__l"), theirs.alias("__r"))
    )
    # null for the keys that aren't dealt out
    rows = rows.withColumn("__b", F.when(F.col("__k").isin(keys), bucket_of(F.col("__t"), bucket)) if keys else F.lit(None).cast("bigint"))
    if direction != "nearest":
        rows = _carried(rows, "__m", direction == "forward", bool(keys))
    else:
        rows = _carried(_carried(rows, "__before_it", False, bool(keys)), "__after_it", True, bool(keys))
        at = lambda c: F.col(f"{c}.{prefix}{time}")
        closer = at("__after_it").isNotNull() & (at("__before_it").isNull() | (at("__after_it") - F.col("__t") < F.col("__t") - at("__before_it")))
        rows = rows.withColumn("__m", F.when(closer, F.col("__after_it")).otherwise(F.col("__before_it")))
    if tolerance:
        moment, limit = F.col(f"__m.{prefix}{time}"), F.expr(f"INTERVAL {tolerance}")
        rows = rows.withColumn("__m", F.when((moment >= F.col("__t") - limit) & (moment <= F.col("__t") + limit), F.col("__m")))
    found = rows.where("__side = 1").select("__l.*", *(F.col(f"__m.{prefix}{c}").alias(prefix + c) for c in right.columns))
    alone = left.where(F.col(on).isNull()).select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(prefix + c) for c in right.columns))
    return found.unionByName(alone)
