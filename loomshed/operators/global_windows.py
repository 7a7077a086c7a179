"""Windows without a partition key, or with a hot one: no task sorts them alone.

Rows are dealt out by ranges of the keys and the order, and written down. Each part computes its own running values; what stands before a
part comes from one row per part and key. Frames of neighbouring rows run over blocks of row numbers, each with the few
rows of its neighbours that its frames reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

#: kind -> how a part's values make one, how values of parts before make one, and how that joins a part's running value.
KINDS = {
    "count": (lambda v: F.count(v), lambda v: F.sum(v), lambda a, b: F.coalesce(a, F.lit(0)) + b),
    "sum": (lambda v: F.sum(v), lambda v: F.sum(v), lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)),
    "min": (lambda v: F.min(v), lambda v: F.min(v), lambda a, b: F.least(a, b)),
    "max": (lambda v: F.max(v), lambda v: F.max(v), lambda a, b: F.greatest(a, b)),
}


def _sorted_by(order: list[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in order]


def running(df: DataFrame, order: list[str], values: dict[str, tuple[str, str | Column]], partition: tuple[str, ...] = (), descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with, under each name of `values` (kind, column), the kind over all rows up to this one: ROWS UNBOUNDED PRECEDING.

    Kinds: count, sum, min, max; nulls are passed over, and where nothing but nulls precedes the result is null (a count 0). Rows equal in all of
    partition and order come in any order among themselves, and lie in one part. An empty table stays empty. A null key is a key.
    """
    by = [*partition, *_sorted_by(order, descending)]
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.withColumns({f"__v_{k}": (F.col(c) if isinstance(c, str) else c) for k, (_, c) in values.items()}).repartitionByRange(n, *by).withColumn("__part", F.spark_partition_id()), "running")
    totals = rows.groupBy("__part", *partition).agg(*(KINDS[kind][0](f"__v_{k}").alias(f"__b_{k}") for k, (kind, _) in values.items()))
    before = lambda w: {f"__b_{k}": KINDS[kind][1](f"__b_{k}").over(w) for k, (kind, _) in values.items()}
    within = Window.partitionBy("__part", *partition).orderBy(*_sorted_by(order, descending)).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumns({f"__w_{k}": KINDS[kind][0](f"__v_{k}").over(within) for k, (kind, _) in values.items()})
    if partition:
        # a key has a row for each part that it lies in; of those only the later ones have something before them
        earlier = totals.withColumns(before(Window.partitionBy(*partition).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
        names = {c: f"__k{i}" for i, c in enumerate(("__part", *partition))}
        on = [F.col(a).eqNullSafe(F.col(b)) for a, b in names.items()]
        found = found.join(earlier.withColumnsRenamed(names), on, "left").drop(*names.values())
    else:
        # one row per part: as many as there are tasks
        sums, table = [None] * len(values), []
        for r in sorted(totals.collect(), key=lambda r: r["__part"]):
            table.append((r["__part"], *sums))
            sums = [_joined(kind, a, r[f"__b_{k}"]) for (k, (kind, _)), a in zip(values.items(), sums, strict=True)]
        schema = ", ".join(["__part int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in totals.schema.fields if f.name.startswith("__b_"))])
        found = found.join(F.broadcast(df.sparkSession.createDataFrame(table, schema)), "__part", "left")
    found = found.withColumns({k: KINDS[kind][2](F.col(f"__b_{k}"), F.col(f"__w_{k}")) for k, (kind, _) in values.items()})
    return found.select(*df.columns, *(k for k in values if k not in df.columns))


def _joined(kind: str, a, b):
    if a is None or b is None:
        return b if a is None else a
    return {"count": a + b, "sum": a + b}[kind] if kind in ("count", "sum") else (min if kind == "min" else max)(a, b)


def numbered(df: DataFrame, order: list[str], name: str, partition: tuple[str, ...] = (), descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with each row's number, from 1."""
    return running(df, order, {name: ("count", F.lit(1))}, partition, descending, parts)


def ranked(df: DataFrame, order: list[str], rank: str, dense: str, descending: bool = False, parts: int | None = None) -> DataFrame:
    """df with rank and dense_rank over all rows: windows over the distinct values and their counts, joined back. A value that many rows share is one of them."""
    counts = df.groupBy(*order).agg(F.count("*").alias("__n"))
    ranks = running(counts, order, {"__upto": ("sum", "__n"), "__dense": ("count", F.lit(1))}, (), descending, parts)
    ranks = ranks.select(*(F.col(c).alias(f"__o{k}") for k, c in enumerate(order)), (F.col("__upto") - F.col("__n") + 1).alias(rank), F.col("__dense").alias(dense))
    on = [F.col(c).eqNullSafe(F.col(f"__o{k}")) for k, c in enumerate(order)]
    return df.join(ranks, on).drop(*(f"__o{k}" for k in range(len(order))))


def framed(df: DataFrame, order: list[str], before: int, after: int, values: dict[str, Column], partition: tuple[str, ...] = (), block: int = 1 << 20, parts: int | None = None) -> DataFrame:
    """df with aggregates over ROWS BETWEEN before PRECEDING AND after FOLLOWING. values: name -> aggregate, such as F.max("x"); it is taken over the frame."""
    if min(before, after) < 0 or max(before, after) > block:
        raise ValueError(f"a frame of {before} and {after} rows doesn't fit blocks of {block}")
    rows = numbered(df, order, "__rn", partition, parts=parts)
    at, here = F.pmod(F.col("__rn"), F.lit(block)), F.floor(F.col("__rn") / block).cast("bigint")
    copies = [F.struct(here.alias("b"), F.lit(False).alias("halo"))]
    copies += [F.when(at >= block - before, F.struct((here + 1).alias("b"), F.lit(True).alias("halo")))] if before else []
    copies += [F.when(at < after, F.struct((here - 1).alias("b"), F.lit(True).alias("halo")))] if after else []
    dealt = rows.withColumn("__c", F.explode(F.array_compact(F.array(*copies)))).withColumns({"__block": F.col("__c.b"), "__halo": F.col("__c.halo")})
    w = Window.partitionBy("__block", *partition).orderBy("__rn").rowsBetween(-before, after)
    return dealt.withColumns({k: a.over(w) for k, a in values.items()}).where("not __halo").select(*df.columns, *values)
