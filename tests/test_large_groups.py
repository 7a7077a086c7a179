"""Selection, windows without a partition key, and inequality joins against brute force: ties, nulls, hot values, empty tables."""

from __future__ import annotations

import math
import random
from math import ceil, floor

import pytest
from pyspark.sql import functions as F

from loomshed.operators.global_windows import framed, numbered, ranked, running
from loomshed.operators.inequality import condition, inequality_anti, inequality_full, inequality_join, inequality_semi, inequality_totals
from loomshed.operators.selection import exact_percentiles


def percentile(values, p):
    x, at = sorted(values), p * (len(values) - 1)
    return x[floor(at)] if floor(at) == ceil(at) else (ceil(at) - at) * x[floor(at)] + (at - floor(at)) * x[ceil(at)]


@pytest.mark.parametrize(("large", "buckets"), [(5, 8), (50, 16), (3, 4096), (10**6, 8)])
def test_percentiles(spark, large, buckets):
    """Groups of ties, of values far apart, of infinities, of nulls and NaN alone, and a null group."""
    rng = random.Random(large)
    groups = {
        "even": [rng.random() for _ in range(300)], "ties": [rng.choice([1.0, 1.0, 2.0]) for _ in range(200)], "far": [10.0**k for k in range(-300, 300, 4)] + [-(10.0**k) for k in range(0, 308, 9)], "one": [5.0] * 90, "ends": [math.inf, -math.inf, 1.0, 2.0, 3.0] * 9,
        None: [float(k % 17) for k in range(77)], "small": [3.0, 1.0], "nothing": [None, math.nan], "widest": [-1.7e308, 1.7e308, 0.0, 1e-320] * 5,
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    wanted = {"low": 0.1, "mid": 0.5, "high": 0.99, "top": 1.0, "least": 0.0}
    got = {r.k: r for r in exact_percentiles(df, ["k"], "v", wanted, large, buckets).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        real = [v for v in vs if v is not None and not math.isnan(v)]
        for name, p in wanted.items():
            want = percentile(real, p) if real else None
            assert got[k][name] == want or math.isclose(got[k][name], want, rel_tol=1e-12) or (math.isnan(want) and math.isnan(got[k][name])), (k, name)


def test_percentiles_of_a_whole_table_and_of_none(spark):
    df = spark.range(1000).withColumn("x", F.col("id") % 37)
    assert [tuple(r) for r in exact_percentiles(df, [], "x", {"m": 0.5}, large=10).collect()] == [(18.0,)]
    assert exact_percentiles(df.limit(0), ["id"], "x", {"m": 0.5}).count() == 0


def table(spark, n, seed=1):
    rng = random.Random(seed)
    return [(k, rng.choice("aab") if rng.random() < 0.95 else None, rng.choice([None, *range(20), *[7] * 20]), rng.random()) for k in range(n)]


SCHEMA = "id int, k string, x int, y double"


@pytest.mark.parametrize("parts", [1, 3, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_running(spark, parts, descending):
    rows = table(spark, 150)
    df = spark.createDataFrame(rows, SCHEMA)
    kinds = {"n": ("count", "x"), "s": ("sum", "x"), "low": ("min", "x"), "high": ("max", "x")}
    for partition in ((), ("k",)):
        got = {r.id: (r.n, r.s, r.low, r.high) for r in running(df, ["y", "id"], kinds, partition, descending, parts).collect()}
        for i, k, _, y in rows:
            before = [r[2] for r in rows if (not partition or r[1] == k) and ((r[3], r[0]) >= (y, i) if descending else (r[3], r[0]) <= (y, i)) and r[2] is not None]
            assert got[i] == (len(before), sum(before) if before else None, min(before, default=None), max(before, default=None))


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_and_frames(spark, parts):
    rows = table(spark, 200, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    key = lambda v: (v is not None, v)  # noqa: E731  nulls first
    got = {r.id: (r.rk, r.dr) for r in ranked(df, ["x"], "rk", "dr", parts=parts).collect()}
    xs = [r[2] for r in rows]
    for i, _, x, _ in rows:
        less = [v for v in xs if key(v) < key(x)]
        assert got[i] == (len(less) + 1, len(set(less)) + 1)
    assert sorted(r.rn for r in numbered(df, ["x", "id"], "rn", parts=parts).collect()) == list(range(1, 201))
    for before, after, block in ((3, 2, 5), (0, 4, 4), (6, 0, 100), (0, 0, 1)):
        for partition in ((), ("k",)):
            got = {r.id: (r.s, r.m) for r in framed(df, ["y"], before, after, {"s": F.count("*"), "m": F.max("y")}, partition, block, parts).collect()}
            for _, k, _, _ in rows[:1] if not partition else {r[1]: r for r in rows}.values():
                order = sorted((r for r in rows if not partition or r[1] == k), key=lambda r: r[3])
                for at, r in enumerate(order):
                    frame = order[max(0, at - before) : at + after + 1]
                    assert got[r[0]] == (len(frame), max(f[3] for f in frame))
    with pytest.raises(ValueError, match="doesn't fit"):
        framed(df, ["y"], 9, 0, {}, block=8)


def test_windows_of_empty_tables_and_plans(spark):
    df = spark.createDataFrame(table(spark, 50), SCHEMA)
    assert running(df.limit(0), ["id"], {"n": ("count", "x")}).count() == 0 == ranked(df.limit(0), ["x"], "a", "b").count() + framed(df.limit(0), ["id"], 1, 1, {"n": F.count("*")}).count()
    for out in (running(df, ["id"], {"n": ("sum", "x")}), ranked(df, ["x"], "a", "b"), framed(df, ["id"], 1, 1, {"n": F.count("*")})):
        assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def sides(spark, seed):
    """Two tables, a third of their values one and the same."""
    rng = random.Random(seed)
    value = lambda: rng.choice([None, 5, 5, 5, 5, *range(10), rng.random() * 10])
    left = [(k, value(), value()) for k in range(90)] + [(0, 5.0, 5.0)]
    right = [(1000 + k, value(), value()) for k in range(70)] + [(1000, 5.0, 5.0)] * 2
    make = lambda rows, names: spark.createDataFrame([(i, *(None if v is None else float(v) for v in vs)) for i, *vs in rows], ", ".join([f"{names[0]} int", *(f"{n} double" for n in names[1:])]))
    return left, right, make(left, ["l", "a", "c"]), make(right, ["r", "b", "d"])


@pytest.mark.parametrize(("ops", "ranges"), [("<", 2), ("<>", 2), (">=<", 256), *((ops, 16) for ops in ("<=", ">", ">=", "<>", "<<=", ">=<", ">>", "<=>="))])
def test_inequality_joins(spark, ops, ranges):
    parts = {"<>": ["<", ">"], "<<=": ["<", "<="], ">=<": [">=", "<"], ">>": [">", ">"], "<=>=": ["<=", ">="]}.get(ops, [ops])
    left, right, a, b = sides(spark, len(ops) + ranges)
    conditions = [f"{x} {op} {y}" for (x, y), op in zip((("a", "b"), ("c", "d")), parts, strict=False)]
    meets = lambda p, q: all(p[k] is not None and q[k] is not None and OPS[op](p[k], q[k]) for k, op in enumerate(parts, 1))
    want = sorted((p[0], q[0]) for p in left for q in right if meets(p, q))
    joined = inequality_join(a, b, *conditions, ranges=ranges)
    assert sorted((r.l, r.r) for r in joined.collect()) == want and want
    if ranges == 16:
        has = [any(meets(p, q) for q in right) for p in left]
        assert sorted(r.l for r in inequality_semi(a, b, *conditions).collect()) == sorted(p[0] for p, h in zip(left, has, strict=True) if h)
        assert sorted(r.l for r in inequality_anti(a, b, *conditions).collect()) == sorted(p[0] for p, h in zip(left, has, strict=True) if not h)
        alone = [(None, q[0]) for q in right if not any(meets(p, q) for p in left)]
        full = [(r.l, r.r) for r in inequality_full(a, b, *conditions).collect()]
        assert sorted(map(str, full)) == sorted(map(str, [*want, *((p[0], None) for p, h in zip(left, has, strict=True) if not h), *alone]))
        assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("ops", ["<<", "<=<", ">=<=", "<>", ">>=", "<=>="])
def test_inequality_totals_make_no_pairs(spark, ops):
    parts = {"<<": ["<", "<"], "<=<": ["<=", "<"], ">=<=": [">=", "<="], "<>": ["<", ">"], ">>=": [">", ">="], "<=>=": ["<=", ">="]}[ops]
    left, right, a, b = sides(spark, len(ops))
    conditions = [f"{x} {op} {y}" for (x, y), op in zip((("a", "b"), ("c", "d")), parts, strict=True)]
    meets = lambda p, q: all(p[k] is not None and q[k] is not None and OPS[op](p[k], q[k]) for k, op in enumerate(parts, 1))
    want = sorted((p[0], len(m), sum(m)) for p in left if (m := [q[0] for q in right if meets(p, q)]))
    assert sorted(tuple(r) for r in inequality_totals(a, b, *conditions, "n", {"s": "r"}).select("l", "n", "s").collect()) == want and want
    assert inequality_totals(a, b.limit(0), *conditions, "n", {"s": "r"}).count() == 0 == inequality_totals(a.limit(0), b, *conditions, "n", {}).count()
    # as many pairs as rows squared, and rows times digits at most under the keys
    many = inequality_totals(spark.range(3000).selectExpr("id l", "id a", "id c"), spark.range(3000).selectExpr("id r", "id + 3000 b", "id + 3000 d"), "a < b", "c < d", "n", {"s": "r"})
    assert many.where("n = 3000 and s = 4498500").count() == 3000


def test_inequality_joins_of_empty_tables(spark):
    _, _, a, b = sides(spark, 1)
    assert inequality_join(a, b.limit(0), "a < b").count() == 0 == inequality_semi(a, b.limit(0), "a < b", "c > d").count()
    assert inequality_anti(a, b.limit(0), "a < b").count() == 91 == inequality_full(a, b.limit(0), "a < b", "c > d").count()
    with pytest.raises(ValueError, match="no inequality"):
        condition("a = b")
