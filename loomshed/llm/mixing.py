"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A source's target over its size is the number of copies each of its documents should get on average. The whole
part is certain; the fraction is a probability, held as a mass of words. Pivotal rounding takes two documents and
moves mass between them, the direction drawn so that each one's expectation stays, until one of them has none or all
of its words. The other stays in play. Groups of neighbours in size are rounded each on its own, what is left of
each group meets in the next level of the tree, and one document a source remains at the root. So a source's
words miss its target by at most half of that document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

FAN_IN = 64


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """__of (a source), source_size, target: weights by the sources' order, the excess over `most` sizes shared anew by weight.

    Ordered by limit per weight, a source is held at its limit if its part of what the ones before it left would
    exceed that; all others get the same amount per weight, the largest such part.
    """
    totals = sized.groupBy("__source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("__source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    return (
        totals.withColumn("weight", weight)
        .withColumn("limit", most * F.col("source_size"))
        .withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(by_limit), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_limit), F.lit(0.0))))
        .withColumn("target", F.least(F.col("limit"), F.col("weight") * F.max("level").over(everything)))
        .select(F.col("__source").alias("__of"), "source_size", "target")
    )


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends on these values alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def pivot(seed: int, fields: list[str]):
    """The step of the fold over a group: acc.item is in play, acc.done has (item, copies)."""

    def let(value: Column, then) -> Column:
        return F.get(F.transform(F.array(value), then), F.lit(0))

    def moved(item: Column, mass: Column) -> Column:
        return F.struct(*(item[f].alias(f) for f in fields), mass.alias("mass"))

    def settle(acc: Column, item: Column, copies: int, survivor: Column) -> Column:
        return F.struct(survivor.alias("item"), F.concat(acc["done"], F.array(F.struct(item.alias("item"), F.lit(copies).alias("copies")))).alias("done"))

    def both(acc: Column, x: Column) -> Column:
        a = acc["item"]
        room_a, room_x = a["size"] - a["mass"], x["size"] - x["mass"]
        gain, lose = F.least(room_a, x["mass"]), F.least(room_x, a["mass"])
        to_a = uniform(F.lit(seed), a["__rank"], x["__rank"], a["size"], x["size"]) * (gain + lose) < lose

        def choose(s: Column) -> Column:
            return (
                F.when(s["to_a"] & (s["room_a"] <= x["mass"]), settle(acc, a, 1, moved(x, x["mass"] - s["room_a"])))
                .when(s["to_a"], settle(acc, x, 0, moved(a, a["mass"] + x["mass"])))
                .when(s["room_x"] <= a["mass"], settle(acc, x, 1, moved(a, a["mass"] - s["room_x"])))
                .otherwise(settle(acc, a, 0, moved(x, a["mass"] + x["mass"])))
            )

        return let(F.struct(to_a.alias("to_a"), room_a.alias("room_a"), room_x.alias("room_x")), choose)

    return both


def mix(sized: DataFrame, key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 1, work: Scratch | None = None) -> DataFrame:
    """key, size, source_size, target, copies of every row of `sized` (key, source, size).

    weights: of the sources in code-point order, null last, repeating; share: of all words that the mix holds; most:
    a source's target is at most so many times its size. Rows without words get no copy. Repeated rows are separate
    rows. The same rows give the same copies however they are stored. Extra columns are ignored.
    """
    work = work or Scratch(sized.sparkSession, "mix")
    rows = work.save(sized.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("__source"), F.coalesce("size", F.lit(0)).cast("bigint").alias("size")), "rows")
    targets = work.save(source_targets(rows, weights, share, most), "targets")
    # a place in the order (source, size, hash of the key): partitions by range, a running number in each, sums of the ones before
    order = [F.col("__source").asc_nulls_last(), F.col("size").desc(), F.xxhash64("__key"), F.col("__key")]
    ranged = rows.where("size > 0").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = work.save(ranged.withColumn("__part", F.shiftright("__at", 33)), "placed")
    parts = placed.groupBy("__source", "__part").agg(F.min("__at").alias("__low"), F.count("*").alias("n"))
    before = Window.partitionBy("__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__source", F.col("__part").alias("__task"), "__low", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"), F.sum("n").over(Window.partitionBy("__source")).alias("__n"))
    of_source = F.col("__source").eqNullSafe(F.col("__of"))
    known = parts.join(targets, of_source).drop("__source")
    ratio = F.col("target") / F.col("source_size")
    level = placed.join(known, of_source & (F.col("__part") == F.col("__task"))).select(
        "__source", (F.col("__at") - F.col("__low") + F.col("__before")).alias("__rank"), "__key", "size", "source_size", "target", F.floor(ratio).cast("int").alias("whole"), ((ratio - F.floor(ratio)) * F.col("size")).alias("mass"), "__n"
    )
    level = work.save(level, "level0")
    out = ["__key", "size", "source_size", "target", "copies"]
    done = [
        level.where("mass <= 0").withColumn("copies", F.col("whole")).select(*out),
        rows.where("size = 0").join(targets, of_source).select("__key", "size", "source_size", "target", F.lit(0).alias("copies")),
    ]
    count = level.agg(F.max("__n").alias("n")).first().n or 0
    level = level.where("mass > 0").drop("__n")
    fields = [c for c in level.columns if c not in ("__source", "mass")]
    depth = 0
    while count:
        group = [F.col("__source"), F.floor(F.col("__rank") / FAN_IN).alias("__group")]
        item = F.struct(*fields, "mass")
        step = pivot(seed + depth, fields)
        items = level.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
        kind = items.schema["items"].dataType.elementType.simpleString()
        start = F.struct(F.get("items", F.lit(0)).alias("item"), F.array().cast(f"array<struct<item:{kind},copies:int>>").alias("done"))
        folded = items.select("__source", "__group", F.aggregate(F.slice("items", 2, FAN_IN), start, step).alias("x"))
        depth += 1
        folded = work.save(folded.select("__source", "__group", "x.item", "x.done"), f"level{depth}")
        settled = folded.select(F.explode("done").alias("d")).select("d.item.*", "d.copies")
        count = -(-count // FAN_IN)
        rest = folded.select("__source", F.col("__group").alias("__rank"), *(F.col(f"item.{f}").alias(f) for f in (*fields, "mass") if f != "__rank"))
        if count == 1:  # one document a source is left: the nearer of none and all of its words
            settled, count = settled.unionByName(rest.withColumn("copies", F.when(2 * F.col("mass") >= F.col("size"), 1).otherwise(0)).select(*settled.columns)), 0
        done.append(settled.withColumn("copies", F.col("copies") + F.col("whole")).select(*out))
        level = rest
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.withColumnRenamed("__key", key)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: what the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", words_in().alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
