"""Operators on small tables: nulls, ties, empty tables."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomshed.functions import vectors
from loomshed.functions.text import ngrams, strip_tags
from loomshed.functions.vectors import cosine
from loomshed.operators.asof import asof_join
from loomshed.operators.ranges import range_join
from loomshed.operators.sessions import sessions
from loomshed.operators.skew import distinct_per_group, heavy_hitters, salted_join
from loomshed.operators.subqueries import not_in
from loomshed.operators.windows import counted_over_groups, distinct_on, over_groups, sum_of_others
from loomshed.sources.tables import round_trip

T = datetime(2024, 1, 1)


def at(minutes: float) -> datetime:
    return T + timedelta(minutes=minutes)


def times(spark, rows):
    return spark.createDataFrame(rows, "id bigint, k string, ts timestamp_ntz")


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("bucket", ["7 minutes", "1 hour"])
def test_asof_in_buckets_is_the_same(spark, direction, bucket):
    left = times(spark, [(k, "ab"[k % 2], at(k * 7 % 200)) for k in range(60)] + [(99, "c", at(0)), (98, None, at(0))])
    right = times(spark, [(100 + k, "ab"[k % 3 % 2], at(k * 37 % 190 // 5 * 5)) for k in range(40)])
    got = [sorted(map(str, asof_join(left, right, "k", "ts", direction, tie="id", bucket=b).collect())) for b in (None, bucket)]
    assert got[0] == got[1] and len(got[0]) == 62


def test_sessions_in_buckets_are_the_same(spark):
    df = times(spark, [(k, "ab"[k % 2], at(k * k * 13 % 900)) for k in range(80)])
    whole, dealt = (sorted(map(str, sessions(df, "k", "ts", "9 minutes", bucket=b).collect())) for b in (None, "17 minutes"))
    assert whole == dealt and len(whole) > 10


@pytest.mark.parametrize(("direction", "tolerance", "expected"), [
    ("backward", None, {1: 11, 2: 12, 3: None, 4: None}), ("forward", None, {1: 11, 2: None, 3: 13, 4: None}), ("nearest", None, {1: 11, 2: 12, 3: 13, 4: None}), ("backward", "5 minutes", {1: 11, 2: None, 3: None, 4: None}),
])
def test_asof(spark, direction, tolerance, expected):
    left = times(spark, [(1, "a", at(10)), (2, "a", at(30)), (3, "b", at(0)), (4, None, at(0))])
    right = times(spark, [(10, "a", at(10)), (11, "a", at(10)), (12, "a", at(20)), (13, "b", at(7))])
    got = asof_join(left, right, "k", "ts", direction, tolerance, tie="id").collect()
    assert {r.id: r.right_id for r in got} == expected


def test_asof_empty_right(spark):
    got = asof_join(times(spark, [(1, "a", at(0))]), times(spark, []), "k", "ts").collect()
    assert [(r.id, r.right_id) for r in got] == [(1, None)]


def test_range_join_meets_once(spark):
    points = spark.createDataFrame([(k, float(k)) for k in range(-5, 25)], "p int, x double")
    ranges = spark.createDataFrame([(0, -4.0, 3.0), (1, 0.0, 0.0), (2, 7.5, 30.0), (3, 5.0, 1.0)], "r int, low double, high double").where("low <= high")
    got = sorted((r.p, r.r) for r in range_join(points, ranges, "x", "low", "high", 4.0).collect())
    assert got == sorted((p, r) for p in range(-5, 25) for r, a, b in ((0, -4, 3), (1, 0, 0), (2, 7.5, 30)) if a <= p <= b)


def test_windows(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 1, None), ("a", 2, 7.0), ("b", 1, 1.0)], "k string, t int, v double")
    w = Window.partitionBy("k")
    assert sorted((r.k, r.s) for r in df.where("v is not null").select("k", sum_of_others("v", w).alias("s")).collect() if r.s is not None) == [("a", 5.0), ("a", 7.0)]
    assert sorted(r.n for r in over_groups(df, F.count("*"), ["k"], "t", 1, 0, "n").collect()) == [1, 2, 2, 3]
    assert distinct_on(df, ["k"], [F.desc("t")]).count() == 2


def test_sessions(spark):
    df = times(spark, [(1, "a", at(0)), (2, "a", at(30)), (3, "a", at(61)), (4, "b", at(0))])
    assert sorted((r.k, r.session, r.n) for r in sessions(df, "k", "ts", "30 minutes").collect()) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1)]


def test_skew(spark):
    big = spark.createDataFrame([("hot", k) for k in range(200)] + [("cold", 1), (None, 2)], "k string, v int")
    other = spark.createDataFrame([("hot", 1), ("hot", 2), ("none", 3)], "k string, w int")
    assert salted_join(big, other, "k", 8).count() == 400
    same = spark.createDataFrame([("hot", {"m": 1})] * 200, "k string, v map<string,int>")
    assert salted_join(same, other, "k", 4).count() == 400
    assert {r.k: r.n for r in distinct_per_group(big, ["k"], "v", "n").collect()} == {"hot": 200, "cold": 1, None: 1}
    assert [r.k for r in heavy_hitters(big, "k", 0.5).collect()] == ["hot"]


def test_functions(spark):
    df = spark.createDataFrame([("<p>a  <b>c</b></p>", [1.0, 0.0], [0.0, 0.0])], "h string, a array<double>, b array<double>")
    row = df.select(strip_tags("h").alias("t"), cosine("a", "b").alias("none"), cosine("a", "a").alias("one"), F.sort_array(ngrams("h", 3)).alias("g")).first()
    assert (row.t, row.none, row.one) == ("a c", None, 1.0)
    assert row.g == sorted({"<p>a  <b>c</b></p>"[k : k + 3] for k in range(16)})


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv", "xml"])
def test_formats_keep_values(spark, kind):
    df = spark.createDataFrame([(1, 'a "b", c', 0.5), (2, "ü\t", -1e9), (3, None, None)], "n int, s string, x double")
    got = sorted((r.n, (r.s or "").strip() or None, r.x) for r in round_trip(df, kind).collect())
    assert got == [(1, 'a "b", c', 0.5), (2, "ü", -1e9), (3, None, None)]


def test_missing_connectors_say_what_they_need(spark, tmp_path):
    from loomshed.sources.connectors import MissingConnector, read_avro, read_kafka

    for read in (lambda: read_avro(spark, str(tmp_path)), lambda: read_kafka(spark, "localhost:1", "t")):
        with pytest.raises(MissingConnector, match="--packages org.apache.spark"):
            read()


def test_jdbc_reads_in_parts(spark, tmp_path):
    """Against the database in Java that Spark brings along."""
    from loomshed.sources.connectors import read_jdbc

    url, driver = f"jdbc:derby:{tmp_path}/db", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    spark.range(100).selectExpr("id AS k", "id * 2 AS v").write.jdbc(f"{url};create=true", "numbers", properties={"driver": driver})
    got = read_jdbc(spark, url, "numbers", "k", 20, 80, 4, driver=driver)
    assert got.rdd.getNumPartitions() == 4 and sorted((r[0], r[1]) for r in got.collect()) == [(k, 2 * k) for k in range(100)]


def test_not_in_follows_the_rules_for_nulls(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    some = lambda *x: spark.createDataFrame([(v,) for v in x], "b int")
    got = lambda others: sorted(str(r.a) for r in not_in(rows, "a", others, "b").collect())
    assert got(some(1, 1)) == ["2"] and got(some(1, None)) == [] and got(some()) == ["1", "2", "None"]


def test_counts_over_groups_and_ranges(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("a", 9), (None, 1), ("a", None)], "k string, t int")
    plain = over_groups(df, F.count("*"), ["k"], "t", 1, 0, "n")
    pairs = lambda d: sorted(map(str, d.select("k", "t", "n").collect()))
    assert pairs(counted_over_groups(df, "k", "t", 1, 0, "n")) == pairs(plain)
    ranged = df.withColumn("n", F.count("*").over(Window.partitionBy("k").orderBy("t").rangeBetween(-1, 0)))
    assert pairs(counted_over_groups(df, "k", "t", 1, 0, "n", by_value=True)) == pairs(ranged)


def test_asof_of_ordinary_keys_and_none(spark):
    """Keys below the share stay where they are, beside one that is dealt out; left rows without a key pass."""
    left = times(spark, [(k, f"k{k % 150}" if k % 3 else "hot", at(k * 7 % 200)) for k in range(450)] + [(900 + k, None, at(k)) for k in range(5)])
    right = times(spark, [(1000 + k, f"k{k % 150}" if k % 2 else "hot", at(k * 37 % 190)) for k in range(400)] + [(1900, None, at(0))])
    for direction in ("backward", "forward", "nearest"):
        got = [sorted(map(str, asof_join(left, right, "k", "ts", direction, tie="id", bucket=b).collect())) for b in (None, "20 minutes")]
        assert got[0] == got[1] and len(got[0]) == 455 and sum(", k=None" in x and "right_id=None" in x for x in got[0]) == 5


def test_salts_by_a_unique_key_come_again(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
    other = df.groupBy("k").agg(F.count("*").alias("n"))
    rows = [sorted(map(tuple, salted_join(df.repartition(p), other, "k", 5, unique=("id",)).collect())) for p in (1, 7)]
    assert rows[0] == rows[1] and len(rows[0]) == 4000


def test_vectors_compared_in_blocks(spark):
    """Every pair once, over several blocks and tasks; nulls, other lengths and vectors without a length give nulls."""
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=4)]) for k in range(1100)] + [(1100, None), (1101, [0.0] * 4), (1102, [1.0, None, 2.0, 3.0]), (1103, [1.0, 2.0]), (1104, rng.normal(size=4).tolist())]
    rows.append((1104, rows[0][1]))
    df = spark.createDataFrame(rows, "id long, v array<double>")
    q = df.where("id % 6 = 0 or id > 1099")
    found = vectors.compared(df.coalesce(1), q, "id", "v", "q", 5)
    same = df.crossJoin(q.toDF("q", "w")).select("q", "id", *(F.round(f("v", "w"), 5).alias(n) for n, f in (("cos", cosine), ("dot", vectors.dot), ("dist", vectors.distance))))
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().executedPlan().toString()
    shown = lambda d: sorted(repr(tuple(None if x is None else round(x, 4) + 0.0 for x in r)) for r in d.collect())
    assert shown(found) == shown(same) and found.count() == len(rows) * q.count()
