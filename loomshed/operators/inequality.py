"""Joins on inequalities of two growing tables, as equalities: no nested loop, and no pair is looked at that a range already rules out.

Both sides' values are cut at common quantiles into 2^d ranges. Where two ranges differ, their numbers part at one binary digit: the smaller has 0
there, the larger 1, and the digits above are the same. So a row that has to be smaller is dealt to the keys (digit, digits above) of its zeros, one
that has to be larger to those of its ones, and each pair of different ranges meets under exactly one key, where all pairs are results. Rows of the
same range meet under a key of their own and are compared. Two inequalities take a key of each. A value that many rows have is a range by itself, whose
rows need no comparison.

Whether a row has any partner needs no join: for one inequality the other side's extreme value is enough, for two the extreme of one value
over all that the other inequality leaves, which is a running value over both sides in order.

Nor do totals over all partners of a row: rows that have to be smaller are numbered in order of the first value, the others get the count of those below
them, and the digits of these numbers are the keys. Under a key all pairs meet the first inequality, so that a running total in order of the second one
is the answer. That is rows x digits however many pairs there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .global_windows import running

#: Both sides meet in so many ranges, a power of two.
RANGES = 256


@dataclass(frozen=True)
class Less:
    """left < right, or left <= right if `equal`; `turned`: left > right, or >=. Columns are compared as doubles; a null or NaN meets nothing."""

    left: str
    right: str
    equal: bool = False
    turned: bool = False

    def holds(self, a: Column, b: Column) -> Column:
        a, b = (b, a) if self.turned else (a, b)
        return a <= b if self.equal else a < b


def condition(text: str) -> Less:
    """Of "left < right", with <, <=, > or >=."""
    left, op, right = text.split()
    if op not in ("<", "<=", ">", ">="):
        raise ValueError(f"no inequality: {text!r}")
    return Less(left, right, "=" in op, ">" in op)


def number(df: DataFrame, name: str) -> Column:
    """A column as a double; times as microseconds."""
    kind = df.schema[name].dataType.typeName()
    c = F.unix_micros(F.col(name).cast("timestamp")) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(name)
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def cuts(values: DataFrame, ranges: int) -> tuple[list[float], set[int]]:
    """Where ranges begin, after the first, and the numbers of those that hold one value. A quantile met twice is a value that many rows have."""
    got = values.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] or []
    heavy = {v for v in got if got.count(v) > 1}
    begins = sorted(set(got) | {math.nextafter(v, math.inf) for v in heavy})
    begins = [b for b in begins if math.isfinite(b)]
    return begins, {begins.index(v) + 1 for v in heavy if v in begins and math.nextafter(v, math.inf) in begins}


def _keys(n: str, smaller: bool, digits: int, single: set[int], equal: bool) -> Column:
    """Keys of a range's number. Of ranges of one value: none of their own if equal values don't count."""
    number = F.col(n)
    own = F.struct(F.lit(-1).alias("d"), number.alias("k"))
    own = F.when(~number.isin(list(single)), own) if single and not equal else own
    digit = lambda d: F.shiftright(number, d).bitwiseAND(F.lit(1))
    return F.array_compact(F.array(own, *(F.when(digit(d) == (0 if smaller else 1), F.struct(F.lit(d).alias("d"), F.shiftright(number, d + 1).alias("k"))) for d in range(digits))))


def _ranged(df: DataFrame, value: str, begins: list[float], name: str) -> DataFrame:
    if not begins:
        return df.withColumn(name, F.lit(0))
    found = Bucketizer(splits=[-math.inf, *begins, math.inf], inputCol=value, outputCol="__range", handleInvalid="keep").transform(df)
    return found.withColumn(name, F.col("__range").cast("int")).drop("__range")


def inequality_join(left: DataFrame, right: DataFrame, *conditions: str, ranges: int = RANGES) -> DataFrame:
    """Pairs of rows for which all conditions (one or two, such as "a < b", left's column first) hold, with the columns of both sides.

    The sides' columns must have different names. Rows that repeat are paired each; an empty side gives no row.
    """
    tests = [condition(c) for c in conditions]
    if not 1 <= len(tests) <= 2:
        raise ValueError("one or two conditions")
    a = left.withColumns({f"__a{k}": number(left, t.left) for k, t in enumerate(tests)})
    b = right.withColumns({f"__b{k}": number(right, t.right) for k, t in enumerate(tests)})
    for k in range(len(tests)):
        a, b = a.where(F.col(f"__a{k}").isNotNull()), b.where(F.col(f"__b{k}").isNotNull())
    for k, t in enumerate(tests):
        begins, single = cuts(a.select(F.col(f"__a{k}").alias("v")).unionAll(b.select(F.col(f"__b{k}").alias("v"))), ranges)
        digits = max(1, len(begins).bit_length())
        dealt = lambda df, v, smaller: _ranged(df, v, begins, "__n").withColumn(f"__key{k}", F.explode(_keys("__n", smaller, digits, single, t.equal))).drop("__n")  # noqa: B023, E731
        a, b = dealt(a, f"__a{k}", not t.turned), dealt(b, f"__b{k}", t.turned)
    pairs = a.join(b, [f"__key{k}" for k in range(len(tests))])
    for k, t in enumerate(tests):
        pairs = pairs.where((F.col(f"__key{k}.d") >= 0) | t.holds(F.col(f"__a{k}"), F.col(f"__b{k}")))
    return pairs.select(*left.columns, *right.columns)


def inequality_totals(left: DataFrame, right: DataFrame, first: str, second: str, n: str, sums: dict[str, str]) -> DataFrame:
    """Left rows that have partners under both conditions, with the number of these (`n`) and sums over right columns (name -> column); no pair is made.

    Left rows that repeat stay and have the same totals. A sum passes over nulls, and is null where all are. An empty side gives no row.
    """
    tests = [condition(first), condition(second)]
    # turned conditions are those of the negated values; adding 0.0 makes -0.0 and 0.0 one
    value = lambda df, t, c: (-number(df, c) if t.turned else number(df, c)) + F.lit(0.0)
    points = left.select(*(value(left, t, t.left).alias(v) for t, v in zip(tests, "xy", strict=True)), F.struct(*left.columns).alias("of")).where("not isnan(x) and not isnan(y)")
    others = right.select(*(value(right, t, t.right).alias(v) for t, v in zip(tests, "xy", strict=True)), *(F.col(c).alias(f"s{k}") for k, c in enumerate(sums.values())))
    # what can't have a partner goes first, by the other side's extremes; right rows at one point are one
    most = others.where("x is not null and y is not null").agg(F.max("x").alias("x"), F.max("y").alias("y")).first()
    if most.x is None:
        points = points.limit(0)
    points = written(points.where((F.col("x") <= F.lit(most.x)) & (F.col("y") <= F.lit(most.y))), "points")
    least = points.agg(F.min("x").alias("x"), F.min("y").alias("y")).first()
    others = others.where((F.col("x") >= F.lit(least.x)) & (F.col("y") >= F.lit(least.y)))
    added = [f"s{k}" for k in range(len(sums))]
    others = others.groupBy("x", "y").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in added))

    # of equal values the right side comes first if they don't count as less, else the left
    side = lambda t, is_right: F.lit(is_right == t.equal)
    both = points.withColumn("e", side(tests[0], False)).unionByName(others.withColumn("e", side(tests[0], True)), allowMissingColumns=True)
    numbered = written(running(both, ["x", "e", "y"], {"k": ("count", F.when(F.col("of").isNotNull(), 1))}), "numbered")
    points = numbered.where("of is not null").withColumn("k", F.col("k") - 1)
    upto = numbered.where("of is null and k > 0").groupBy("k", "y").agg(*(F.sum(c).alias(c) for c in ("n", *added)))

    digits = max(1, (numbered.agg(F.max("k")).first()[0] or 0).bit_length())
    digit = lambda d: F.shiftright("k", d).bitwiseAND(F.lit(1))
    keys = lambda smaller: F.explode(F.array_compact(F.array(*(F.when(digit(d) == (0 if smaller else 1), F.struct(F.lit(d).alias("d"), F.shiftright("k", d + 1).alias("above"))) for d in range(digits))))).alias("key")
    # those that are larger in the second value come before what they are larger than
    rows = points.select(keys(True), (-F.col("y")).alias("y"), (~side(tests[1], False)).alias("e"), F.col("k").alias("id"))
    rows = rows.unionByName(upto.select(keys(False), (-F.col("y")).alias("y"), (~side(tests[1], True)).alias("e"), "n", *added), allowMissingColumns=True)
    rows = rows.select(F.col("key.d").alias("d"), F.col("key.above").alias("above"), "y", "e", "id", "n", *added)
    totals = running(rows, ["y", "e"], {f"t_{c}": ("sum", c) for c in ("n", *added)}, ("d", "above")).where("id is not null")
    totals = totals.groupBy("id").agg(*(F.sum(f"t_{c}").alias(f"t_{c}") for c in ("n", *added))).where("t_n > 0")
    return points.select("of", "k").join(totals, F.col("k") == F.col("id")).select("of.*", F.col("t_n").cast("bigint").alias(n), *(F.col(f"t_{c}").alias(name) for c, name in zip(added, sums, strict=True)))


def marked(left: DataFrame, right: DataFrame, conditions: tuple[str, ...], name: str) -> DataFrame:
    """left with `name`: whether any right row meets all conditions (one or two)."""
    tests = [condition(c) for c in conditions]
    first = tests[0]
    if len(tests) == 1:
        # the right side's extreme value answers for all of it
        best = right.agg((F.min if first.turned else F.max)(number(right, first.right))).scalar()
        return left.withColumn(name, F.coalesce(first.holds(number(left, first.left), best), F.lit(False)))
    second = tests[1]
    x, y = number(left, first.left), number(right, first.right)
    # in an order in which all right rows that meet the first condition come before a left row
    side = lambda is_right: F.lit((0 if is_right else 1) if first.equal else (1 if is_right else 0)).alias("__side")
    ordered = lambda v: (v if first.turned else -v).alias("__x")
    rows = left.select(ordered(x), side(False), F.lit(None).cast("double").alias("__d"), F.struct(*left.columns).alias("__l")).unionByName(
        right.where(y.isNotNull()).select(ordered(y), side(True), number(right, second.right).alias("__d"), F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("__l"))
    )
    # a hot value is dealt out by a number of its own: within a value and side the order doesn't matter
    spread = rows.withColumn("__s", F.xxhash64("__d", "__l"))
    upto = running(spread, ["__x", "__side", "__s"], {"__best": ("min" if second.turned else "max", "__d")}).where("__l is not null")
    c = number(left, second.left)
    found = upto.select("__l.*", "__x", "__best")
    return found.withColumn(name, F.coalesce(F.col("__x").isNotNull() & second.holds(c, F.col("__best")), F.lit(False))).drop("__x", "__best")


def inequality_semi(left: DataFrame, right: DataFrame, *conditions: str) -> DataFrame:
    """Left rows that have a partner."""
    return marked(left, right, conditions, "__has").where("__has").drop("__has")


def inequality_anti(left: DataFrame, right: DataFrame, *conditions: str) -> DataFrame:
    """Left rows that have none, those with nulls among them."""
    return marked(left, right, conditions, "__has").where("not __has").drop("__has")


def inequality_full(left: DataFrame, right: DataFrame, *conditions: str) -> DataFrame:
    """Pairs, and with nulls for the other side the rows of either that have no partner."""
    turned = [" ".join((r, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op], a)) for a, op, r in (c.split() for c in conditions)]
    pairs = inequality_join(left, right, *conditions)
    return pairs.unionByName(inequality_anti(left, right, *conditions), allowMissingColumns=True).unionByName(inequality_anti(right, left, *turned), allowMissingColumns=True)
