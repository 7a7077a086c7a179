"""Sketches, bitmaps, fixpoints, EXCLUDE, two-phase aggregates and partitions: nulls, ties, empty tables, plans."""

from __future__ import annotations

import math
import random

import pytest
from compare import connection
from pyspark.sql import functions as F

from loomshed import plans
from loomshed.operators.fixpoint import fixpoint, hops
from loomshed.operators.rollups import THETA_ERROR, bitmaps, distinct_counts, in_common, merged_sketches, sketched
from loomshed.operators.two_phase import trimmed_means
from loomshed.operators.windows import excluding

FOLDER = "/root/testdata/sf0.01"


def test_sketches_merge_and_pass_over_nulls(spark):
    df = spark.range(6000).select((F.col("id") % 2).alias("k"), (F.col("id") % 10).alias("day"), F.when(F.col("id") % 7 > 0, F.col("id") % 3000).alias("item"), F.col("id").cast("double").alias("v"))
    days = sketched(df, ["k", "day"], "item", "v")
    whole = {r.k: r for r in merged_sketches(days, ["k"]).select("k", "n", F.hll_sketch_estimate("hll").alias("h"), F.theta_sketch_estimate("theta").alias("t"), F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("m")).collect()}
    for k in (0, 1):
        exact = len({i % 3000 for i in range(6000) if i % 2 == k and i % 7})
        assert whole[k].n == 3000 and abs(whole[k].h - exact) < 0.05 * exact and abs(whole[k].t - exact) < 0.05 * exact and abs(whole[k].m - 3000) < 200
    common = in_common(days.where("k = 0"), days.where("k = 0"), ["day"]).collect()
    assert len(common) == 5 and all(abs(r.common - 300) <= THETA_ERROR * 300 + 60 for r in common)
    assert sketched(df.limit(0), ["k"], "item", "v").count() == 0 == merged_sketches(days.limit(0), ["k"]).count()


def test_bitmaps_count_exactly(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), rng.choice([1, 2, None]), rng.choice([None, rng.randrange(100), rng.randrange(10**6)])) for _ in range(600)]
    df = spark.createDataFrame(rows, "k string, d int, item bigint")
    got = {(r.grouping, r.k, r.d): r.n for r in distinct_counts(bitmaps(df, ["k", "d"], "item"), ["k", "d"], ["d"], []).collect()}
    pick = lambda test: len({i for k, d, i in rows if i is not None and test(k, d)})
    want = {(0, a, b): pick(lambda k, d: (k, d) == (a, b)) for a, b in {(k, d) for k, d, i in rows if i is not None}} | {(1, None, b): pick(lambda k, d: d == b) for b in (1, 2, None)} | {(2, None, None): pick(lambda k, d: True)}
    assert got == want
    none = {(r.grouping, r.n) for r in distinct_counts(bitmaps(df.limit(0), ["k"], "item"), ["k"], []).collect()}
    assert none == {(1, 0)}


def test_hops_equal_a_walk(spark):
    """Cycles, self loops, repeated edges, nulls, and a path of many rounds."""
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(50)] + [("n1", "n1"), ("n1", "n2"), ("n1", "n2"), (None, "n3"), ("n4", None)] + [(f"p{k}", f"p{k + 1}") for k in range(22)]
    df = spark.createDataFrame(edges, "a string, b string")
    seeds = spark.createDataFrame([("n1",), ("n1",), ("p0",), ("alone",)], "node string")
    known, now = {"n1": 0, "p0": 0, "alone": 0}, ["n1", "p0", "alone"]
    while now:
        then = []
        for a in now:
            for x, b in edges:
                if x == a and b not in known:
                    known[b] = known[a] + 1
                    then.append(b)
        now = then
    assert {r.node: r.hops for r in hops(df, seeds).collect()} == known
    assert hops(df, seeds.limit(0)).count() == 0 and hops(df.limit(0), seeds).count() == 3
    with pytest.raises(ValueError, match="nothing settled"):
        fixpoint(spark.range(1), lambda new: new.select((F.col("id") + 1).alias("id")), ["id"], rounds=3)


@pytest.mark.parametrize("exclude", ["current row", "group", "ties"])
def test_exclude_equals_brute_force(spark, exclude):
    rng = random.Random(6)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(6), rng.choice([None, *range(9)])) for k in range(80)]
    df = spark.createDataFrame(rows, "id int, k string, o int, v int")
    kinds = {"most": ("max", "v"), "least": ("min", "v"), "n": ("count", "v"), "total": ("sum", "v"), "ids": ("list", "id")}
    got = {r.id: r for r in excluding(df.repartition(3), ["k"], [F.col("o")], 4, 3, exclude, kinds).collect()}
    assert len(got) == 80
    for key in ("a", "b", None):
        part = [r for r in rows if r[1] == key]
        # rows of one order value come in any order: what holds of every order is checked
        for r in part:
            ids = set(got[r[0]].ids)
            frame = [x for x in part if x[0] in ids]
            assert len(ids) <= 8 and all(x in part for x in frame)
            assert (r[0] in ids) == (exclude == "ties") and (exclude == "current row" or not any(x[2] == r[2] and x[0] != r[0] for x in frame))
            vs = [x[3] for x in frame if x[3] is not None]
            assert (got[r[0]].most, got[r[0]].least, got[r[0]].n, got[r[0]].total) == (max(vs, default=None), min(vs, default=None), len(vs), sum(vs) if vs else None)
    with pytest.raises(ValueError, match="no EXCLUDE"):
        excluding(df, ["k"], [F.col("o")], 1, 1, "others", {})
    assert excluding(df.limit(0), ["k"], [F.col("o")], 1, 1, exclude, kinds).count() == 0


@pytest.mark.parametrize("exclude", ["group", "ties"])
def test_excluding_reruns_agree(spark, exclude):
    """A frame's edge cuts peers off by the unique key, however the rows come."""
    rows = [(k, k * 7 % 3, k * 5 % 11) for k in range(60)]
    want = {}
    by = sorted(rows, key=lambda r: (r[1], r[0]))
    for at, r in enumerate(by):
        frame = by[max(0, at - 4) : at + 4]
        want[r[0]] = [x[0] for x in frame if x[1] != r[1] or (exclude == "ties" and x[0] == r[0])]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, 60), "id int, o int, v int").withColumn("k", F.lit(1))
        got = excluding(df, ["k"], [F.col("o")], 4, 3, exclude, {"ids": ("list", "id")}, (F.col("id"),)).collect()
        assert {r.id: r.ids for r in got} == want


@pytest.mark.parametrize("name", ["window_exclude_group", "window_exclude_ties"])
def test_exclude_beyond_the_frame(spark, name):
    """At sf0.1 some users have more events than a frame's half: their rows are as the SQL's with event_id behind the day, all others as the SQL's."""
    plans.load()
    folder, con = "/root/testdata/sf0.1", connection("/root/testdata/sf0.1")
    got = {r.event_id: tuple(r)[1:] for r in plans.QUERIES[name](spark, folder).collect()}
    few = "event_id IN (SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) <= 91))"
    same = con.execute(f"SELECT * FROM ({plans.ORACLES[name]}) WHERE {few}").fetchall()
    assert len(got) == 100_000 and 99_000 < len(same) < 100_000 and all(got[r[0]] == r[1:] for r in same)
    rows = "SELECT *, date_trunc('day', ts) AS day, round(value * 100)::BIGINT AS cents FROM events"
    w = "OVER (PARTITION BY user_id ORDER BY day, event_id ROWS BETWEEN 90 PRECEDING AND 90 FOLLOWING)"
    for key, day, frame in con.execute(f"SELECT event_id, day, frame FROM (SELECT event_id, day, list({{'id': event_id, 'day': day, 'cents': cents}}) {w} AS frame FROM ({rows})) WHERE NOT {few}").fetchall():
        left = [x["cents"] for x in frame if x["day"] != day or (name == "window_exclude_ties" and x["id"] == key)]
        assert got[key] == ((len(left), max(left), float(sum(left))) if name == "window_exclude_group" else (len(left),))


def test_trimmed_means(spark):
    """A hot key, a null key, nulls and NaN, values below zero, a key of one value."""
    rng = random.Random(7)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, math.nan, *map(float, range(-20, 21))])) for _ in range(900)] + [("one", 5.0), ("none", None)]
    got = {r.k: (r.n, r.trimmed) for r in trimmed_means(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v", 0.1, 1.0).collect()}
    for key in ("a", "b", None, "one"):
        vs = sorted(v for k, v in rows if k == key and v is not None and not math.isnan(v))
        cut = math.floor(0.1 * len(vs))
        assert got[key][0] == len(vs) and math.isclose(got[key][1], sum(vs[cut : len(vs) - cut]) / (len(vs) - 2 * cut), abs_tol=1e-9)
    assert set(got) == {"a", "b", None, "one"} and trimmed_means(spark.createDataFrame([], "k string, v double"), "k", "v", 0.1, 1.0).count() == 0


def test_plans(spark):
    plan = lambda n: plans.QUERIES[n](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    plans.load()
    assert "dynamicpruning" in plan("partition_pruning_by_join")
    assert "NestedLoop" not in plan("join_inequality") + plan("join_semi_inequality") + plan("join_anti_one_inequality") + plan("join_interval")
    assert "SinglePartition" not in plan("window_running_total") + plan("window_global_frame") + plan("window_global_rank")
