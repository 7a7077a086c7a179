"""Window clauses that Spark's parser doesn't know: QUALIFY, GROUPS frames, EXCLUDE, DISTINCT ON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qualify(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which a condition over window functions holds."""
    return df.withColumn("__qualify", condition).where("__qualify").drop("__qualify")


def over_groups(df: DataFrame, aggregate: Column, partition: list[str], order: str, before: int, after: int, name: str) -> DataFrame:
    """aggregate over the peers of `before` groups back to `after` groups on: dense ranks make them an integer range."""
    ranked = df.withColumn("__group", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    frame = Window.partitionBy(*partition).orderBy("__group").rangeBetween(-before, after)
    return ranked.withColumn(name, aggregate.over(frame)).drop("__group")


def counted_over_groups(df: DataFrame, partition: str, order: str, before: int, after: int, name: str, by_value: bool = False) -> DataFrame:
    """count(*) over GROUPS, or with by_value over a RANGE of the values: counts per distinct value are what the window runs over, however many rows a partition has."""
    counts = df.groupBy(partition, order).agg(F.count("*").alias("__n"))
    at = order if by_value else "__group"
    ranked = counts if by_value else counts.withColumn("__group", F.dense_rank().over(Window.partitionBy(partition).orderBy(order)))
    found = ranked.select(F.col(partition).alias("__p"), F.col(order).alias("__o"), F.sum("__n").over(Window.partitionBy(partition).orderBy(at).rangeBetween(-before, after)).alias(name))
    return df.join(found, F.col(partition).eqNullSafe(F.col("__p")) & F.col(order).eqNullSafe(F.col("__o"))).drop("__p", "__o")


def sum_of_others(value: str, window) -> Column:
    """Sum over the frame without the current row; null where the frame holds no other row."""
    rest = F.count("*").over(window) - 1
    return F.when(rest > 0, F.sum(value).over(window) - F.coalesce(F.col(value), F.lit(0)))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; Spark keeps only a group's head while it sorts."""
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return qualify(df, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= n)


def excluding(df: DataFrame, partition: list[str], order: list[str], before: int, after: int, exclude: str, values: dict[str, tuple[str, str]], ties: tuple[Column, ...] = ()) -> DataFrame:
    """df with aggregates over ROWS BETWEEN before PRECEDING AND after FOLLOWING EXCLUDE current row, group or ties.

    values: name -> (kind, column), kinds max, min, sum, count and list (in frame order). A frame of which nothing is left gives null, a count 0, a list [].
    The frame's rows, before + after + 1 at most, are gathered for each row; peers are those equal in `order`. Which of
    them a frame's edge cuts off is open unless `ties` orders them: with a unique key there, reruns agree.
    """
    if exclude not in ("current row", "group", "ties"):
        raise ValueError(f"no EXCLUDE {exclude!r}")
    peers, w = (Window.partitionBy(*partition).orderBy(*order, *by) for by in ((), ties))
    rows = df.withColumns({"__rn": F.row_number().over(w), "__peers": F.rank().over(peers)})
    frame = F.collect_list(F.struct(F.col("__rn").alias("at"), F.col("__peers").alias("peers"), *(F.col(c).alias(f"v{k}") for k, (_, c) in enumerate(values.values())))).over(w.rowsBetween(-before, after))
    gone = {"current row": lambda x: x["at"] == F.col("__rn"), "group": lambda x: x["peers"] == F.col("__peers"), "ties": lambda x: (x["peers"] == F.col("__peers")) & (x["at"] != F.col("__rn"))}[exclude]
    rows = rows.withColumn("__frame", frame).withColumn("__frame", F.filter("__frame", lambda x: ~gone(x)))
    kinds = {
        "max": F.array_max, "min": F.array_min, "list": lambda a: a, "count": lambda a: F.size(F.array_compact(a)).cast("bigint"),
        "sum": lambda a: F.when(F.size(F.array_compact(a)) > 0, F.aggregate(F.array_compact(a), F.lit(0).cast("double"), lambda s, x: s + x)),
    }
    of = lambda k: F.transform("__frame", lambda x: x[f"v{k}"])
    return rows.withColumns({n: kinds[kind](of(k)) for k, (n, (kind, _)) in enumerate(values.items())}).drop("__rn", "__peers", "__frame")
