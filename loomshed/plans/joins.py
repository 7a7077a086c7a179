"""Joins of all kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.asof import asof_join
from ..operators.inequality import inequality_anti, inequality_full, inequality_semi, inequality_totals
from ..operators.ranges import range_join
from ..operators.skew import heavy_hitters, salted_join
from ..sources.tables import table
from . import query


def _marked(spark, d):
    """Documents and labels whose keys match in part."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    labels = table(spark, d, "labels").select((F.col("doc_id") + 5).alias("label_id"), "quality")
    return docs, labels


@query("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def join_inner(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "customers", "balance")


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id + 5")
def join_left(spark, d):
    docs, labels = _marked(spark, d)
    return docs.join(labels, F.col("doc_id") == F.col("label_id"), "left").select("doc_id", "lang", "quality")


@query("SELECT l.doc_id + 5 AS label_id, d.lang, l.quality FROM documents d RIGHT JOIN labels l ON d.doc_id = l.doc_id + 5")
def join_right(spark, d):
    docs, labels = _marked(spark, d)
    return docs.join(labels, F.col("doc_id") == F.col("label_id"), "right").select("label_id", "lang", "quality")


@query("SELECT d.doc_id, l.doc_id + 5 AS label_id, l.quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id + 5")
def join_full(spark, d):
    docs, labels = _marked(spark, d)
    return docs.join(labels, F.col("doc_id") == F.col("label_id"), "full").select("doc_id", "label_id", "quality")


@query("SELECT a.n_name AS a, b.r_name AS b FROM nation a FULL JOIN region b ON a.n_nationkey < b.r_regionkey - 2")
def join_full_theta(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_nationkey") < F.col("r_regionkey") - 2, "full").select(F.col("n_name").alias("a"), F.col("r_name").alias("b"))


@query("SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 0)")
def join_semi(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("quality = 0"), "doc_id", "left_semi").select("doc_id", "lang")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE s_acctbal < n_nationkey * -35.0)")
def join_semi_theta(spark, d):
    """An inequality against a table of fixed size."""
    return table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_acctbal") < F.col("n_nationkey") * -35.0, "left_semi").select("s_suppkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    """Of two tables of fixed size."""
    return table(spark, d, "region").crossJoin(table(spark, d, "nation")).select("r_name", "n_name")


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def join_using(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("SELECT doc_id, toxic FROM (SELECT doc_id, source FROM documents) NATURAL JOIN labels")
def join_natural(spark, d):
    return spark.sql("SELECT doc_id, toxic FROM {docs} NATURAL JOIN {labels}", docs=table(spark, d, "documents").select("doc_id", "source"), labels=table(spark, d, "labels"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""
    WITH bands AS (SELECT p_partkey AS band, p_retailprice AS low, p_retailprice + 2 AS high FROM part)
    SELECT band, s_suppkey FROM supplier JOIN bands ON abs(s_acctbal) / 5 BETWEEN low AND high
""")
def join_range_band(spark, d):
    """Points in bands, through buckets of equal width in place of a nested loop."""
    bands = table(spark, d, "part").select(F.col("p_partkey").alias("band"), F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 2).alias("high"))
    points = table(spark, d, "supplier").select("s_suppkey", (F.abs("s_acctbal") / 5).alias("at"))
    return range_join(points, bands, "at", "low", "high", 4.0).select("band", "s_suppkey")


@query("""
    SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR
""")
def join_interval(spark, d):
    """Clicks in the six hours after a view of the same user: a user's rows meet by stretches of six hours, not all with all."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    hours = 6 * 3600 * 1_000_000
    a = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), (F.col("at") + 1).alias("low"), (F.col("at") + hours).alias("high"))
    b = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), "at")
    return range_join(b, a, "at", "low", "high", float(hours), on="user_id").select("view_id", "click_id")


def _clicks_and_views(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'view'").drop("event_type")


_SIDES = "(SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') a {} JOIN (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view') b"


@query(f"SELECT a.event_id, b.event_id AS right_event_id FROM {_SIDES.format('ASOF LEFT')} ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_backward(spark, d):
    """Each purchase with the user's last view before it."""
    a, b = _clicks_and_views(spark, d)
    return asof_join(a, b, "user_id", "ts", bucket="5 days").select("event_id", "right_event_id")


@query(f"SELECT a.event_id, b.event_id AS right_event_id FROM {_SIDES.format('ASOF LEFT')} ON a.user_id = b.user_id AND a.ts <= b.ts")
def asof_forward(spark, d):
    a, b = _clicks_and_views(spark, d)
    return asof_join(a, b, "user_id", "ts", "forward", bucket="5 days").select("event_id", "right_event_id")


@query(f"""
    SELECT event_id, right_event_id FROM (
      SELECT a.event_id, b.event_id AS right_event_id, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(a.ts) - epoch_us(b.ts)), b.ts) AS k FROM {_SIDES.format('LEFT')} ON a.user_id = b.user_id)
    WHERE k = 1
""")
def asof_nearest(spark, d):
    a, b = _clicks_and_views(spark, d)
    return asof_join(a, b, "user_id", "ts", "nearest", bucket="5 days").select("event_id", "right_event_id")


@query(f"SELECT a.event_id, CASE WHEN b.ts >= a.ts - INTERVAL 2 HOUR THEN b.event_id END AS right_event_id FROM {_SIDES.format('ASOF LEFT')} ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_tolerance(spark, d):
    a, b = _clicks_and_views(spark, d)
    return asof_join(a, b, "user_id", "ts", tolerance="2 hours", bucket="5 days").select("event_id", "right_event_id")


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def join_merge_hint(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    j = li.join(table(spark, d, "orders").select("o_orderkey", "o_orderpriority").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
def join_shuffle_hash_hint(spark, d):
    j = table(spark, d, "lineitem").select("l_orderkey").join(table(spark, d, "orders").select("o_orderkey", "o_orderstatus").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT l_linestatus, n_name, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def join_salted(spark, d):
    """A hot key's rows dealt to several tasks."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    j = salted_join(table(spark, d, "lineitem").select("l_suppkey", "l_linestatus", "l_orderkey", "l_linenumber"), s, "l_suppkey", 4, unique=("l_orderkey", "l_linenumber")).groupBy("l_linestatus", "s_nationkey").agg(F.count("*").alias("n"))
    return j.join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("l_linestatus", "n_name", "n")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang HAVING count(*) >= 0.12 * (SELECT count(*) FROM documents)")
def heavy_keys(spark, d):
    return heavy_hitters(table(spark, d, "documents"), "lang", 0.12)


@query("SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_broadcast_hint(spark, d):
    """Two tables of fixed size go to all tasks; the large one isn't shuffled for its joins."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n"))


@query("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > c.c_nationkey AND n_regionkey = 0)")
def join_anti_theta(spark, d):
    """An inequality against a table of fixed size."""
    n = table(spark, d, "nation").where("n_regionkey = 0").select("n_nationkey")
    return table(spark, d, "customer").join(n, F.col("n_nationkey") > F.col("c_nationkey"), "left_anti").select("c_custkey")


_LATE = "o_totalprice < l_extendedprice / 40 AND o_orderdate > l_shipdate + INTERVAL 1500 DAY"


def _orders_and_lines(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return o, table(spark, d, "lineitem").select("l_orderkey", "l_quantity", (F.col("l_extendedprice") / 40).alias("bound"), (F.col("l_shipdate") + F.expr("INTERVAL 1500 DAYS")).alias("due"))


@query(f"SELECT o_orderkey, count(*) AS n, sum(l_quantity)::BIGINT AS quantity FROM orders JOIN lineitem ON {_LATE} GROUP BY o_orderkey")
def join_inequality(spark, d):
    """Two inequalities between two growing tables: totals over all pairs, of which there are many more than rows, from running totals under equal keys."""
    o, li = _orders_and_lines(spark, d)
    found = inequality_totals(o, li, "o_totalprice < bound", "o_orderdate > due", "n", {"quantity": "l_quantity"})
    return found.groupBy("o_orderkey").agg(F.sum("n").alias("n"), F.sum("quantity").cast("bigint").alias("quantity"))


@query(f"SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE {_LATE})")
def join_semi_inequality(spark, d):
    """Whether an order has a partner: a running extreme over both tables in order."""
    o, li = _orders_and_lines(spark, d)
    return inequality_semi(o, li, "o_totalprice < bound", "o_orderdate > due").select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE {_LATE})")
def join_anti_inequality(spark, d):
    o, li = _orders_and_lines(spark, d)
    return inequality_anti(o, li, "o_totalprice < bound", "o_orderdate > due").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice * 0.2 > l_extendedprice)")
def join_anti_one_inequality(spark, d):
    """One inequality: the other table's extreme value decides."""
    o = table(spark, d, "orders").select((F.col("o_totalprice") * 0.2).alias("price"))
    return inequality_anti(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), o, "l_extendedprice < price").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_acctbal < s_acctbal - 10400 AND c_custkey >= s_suppkey")
def join_full_inequality(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") - 10400).alias("bound"))
    return inequality_full(table(spark, d, "customer").select("c_custkey", "c_acctbal"), s, "c_acctbal < bound", "c_custkey >= s_suppkey").select("c_custkey", "s_suppkey")
