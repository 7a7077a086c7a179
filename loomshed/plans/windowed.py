"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.global_windows import framed, ranked, running
from ..operators.windows import counted_over_groups, excluding, over_groups, qualify, sum_of_others, top_per_group
from ..sources.tables import table
from . import query

_W = "OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)"


@query(f"""
    SELECT o_orderkey, row_number() {_W} AS rn, rank() {_W} AS rk, dense_rank() {_W} AS dr, ntile(4) {_W} AS nt, round(percent_rank() {_W}, 6) AS pr, round(cume_dist() {_W}, 6) AS cd FROM orders
""")
def window_ranking(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    whole = {"rn": F.row_number(), "rk": F.rank(), "dr": F.dense_rank(), "nt": F.ntile(4)}
    return table(spark, d, "orders").select("o_orderkey", *(f.over(w).cast("bigint").alias(n) for n, f in whole.items()), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query("""
    SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2, -1.0) OVER w AS later, first_value(event_id) OVER w AS first, last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last, nth_value(event_id, 2) OVER w AS second
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def window_offsets(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("later"), F.first("event_id").over(w).alias("first"), F.last("event_id").over(everything).alias("last"), F.nth_value("event_id", 2).over(w).alias("second")
    )


@query("""
    SELECT event_id, sum(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)::BIGINT AS s, max(cents) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS m
    FROM (SELECT *, round(value * 100)::BIGINT AS cents FROM events)
""")
def window_rows(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("bigint")
    return table(spark, d, "events").select("event_id", F.sum(cents).over(w.rowsBetween(-2, 1)).alias("s"), F.max(cents).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("m"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM part")
def window_range(spark, d):
    return counted_over_groups(table(spark, d, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", "p_size", 3, 3, "near", by_value=True).select("p_partkey", "near")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY cents RANGE BETWEEN 2000000 PRECEDING AND 2000000 FOLLOWING) AS near FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders)")
def window_range_frame(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    return o.select("o_orderkey", F.count("*").over(Window.partitionBy("o_custkey").orderBy("cents").rangeBetween(-2000000, 2000000)).alias("near"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def window_range_interval(spark, d):
    return spark.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM {events}", events=table(spark, d, "events"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n FROM orders")
def window_groups(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return counted_over_groups(o, "o_orderpriority", "o_orderdate", 1, 1, "n").select("o_orderkey", "n")


@query("SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 4) AS most FROM events")
def window_groups_any(spark, d):
    """Any aggregate over GROUPS, by dense ranks."""
    e = table(spark, d, "events").select("event_id", "user_id", "value", F.date_trunc("day", "ts").alias("day"))
    return over_groups(e, F.max("value"), ["user_id"], "day", 1, 0, "most").select("event_id", F.round("most", 4).alias("most"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING EXCLUDE CURRENT ROW), 3) AS others FROM events")
def window_exclude_current(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 3)
    return table(spark, d, "events").select("event_id", F.round(sum_of_others("value", w), 3).alias("others"))


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def window_qualify_top(spark, d):
    """Per-group top-k: Spark drops the rest before it shuffles."""
    return top_per_group(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_orderkey", "o_custkey")


@query("SELECT doc_id, n_chars FROM documents QUALIFY n_chars > 2 * avg(n_chars) OVER (PARTITION BY lang)")
def window_qualify_mean(spark, d):
    """A partition's mean is an aggregate of a few rows that is joined: no task holds a whole language."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    means = docs.groupBy(F.col("lang").alias("of")).agg(F.avg("n_chars").alias("mean"))
    return docs.join(means, F.col("lang").eqNullSafe(F.col("of"))).where(F.col("n_chars") > 2 * F.col("mean")).select("doc_id", "n_chars")


@query("SELECT o_orderkey FROM orders QUALIFY o_totalprice > 1.5 * avg(o_totalprice) OVER (PARTITION BY o_custkey)")
def window_qualify_any(spark, d):
    """Any condition over windows, on a key of many groups."""
    return qualify(table(spark, d, "orders"), F.col("o_totalprice") > 1.5 * F.avg("o_totalprice").over(Window.partitionBy("o_custkey"))).select("o_orderkey")


@query("SELECT event_id, last_value(purchase IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS purchase FROM events)")
def window_ignore_nulls(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@query("SELECT user_id, day, n, sum(n) OVER (PARTITION BY user_id ORDER BY day)::BIGINT AS running FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n FROM events GROUP BY ALL)")
def window_over_aggregate(spark, d):
    days = table(spark, d, "events").groupBy("user_id", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumn("running", F.sum("n").over(Window.partitionBy("user_id").orderBy("day")))


_LINES = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


@query(f"SELECT {_LINES}, sum(l_quantity) OVER w AS total, max(l_extendedprice) OVER w AS dearest, count(*) OVER w AS n FROM lineitem WINDOW w AS (ORDER BY {_LINES} ROWS UNBOUNDED PRECEDING)")
def window_running_total(spark, d):
    """Running values over a whole table: parts by range, each with what stands before it."""
    columns = _LINES.split(", ")
    li = table(spark, d, "lineitem").select(*columns, "l_extendedprice")
    return running(li, columns, {"total": ("sum", "l_quantity"), "dearest": ("max", "l_extendedprice"), "n": ("count", F.lit(1))}).drop("l_extendedprice")


@query(f"SELECT l_returnflag, {_LINES}, sum(l_quantity) OVER w AS total, min(l_extendedprice) OVER w AS cheapest FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY {_LINES} ROWS UNBOUNDED PRECEDING)")
def window_running_hot(spark, d):
    """The same by a key of three values."""
    columns = _LINES.split(", ")
    li = table(spark, d, "lineitem").select("l_returnflag", *columns, "l_extendedprice")
    return running(li, columns, {"total": ("sum", "l_quantity"), "cheapest": ("min", "l_extendedprice")}, ("l_returnflag",)).drop("l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_shipdate, rank() OVER (ORDER BY l_shipdate) AS rk, dense_rank() OVER (ORDER BY l_shipdate) AS dr FROM lineitem")
def window_global_rank(spark, d):
    return ranked(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_shipdate"], "rk", "dr")


@query(f"SELECT {_LINES}, round(avg(l_quantity) OVER w, 6) AS mean, max(l_extendedprice) OVER w AS dearest FROM lineitem WINDOW w AS (ORDER BY {_LINES} ROWS BETWEEN 5 PRECEDING AND 3 FOLLOWING)")
def window_global_frame(spark, d):
    """A frame of rows over a whole table: blocks of row numbers, each with the few rows of its neighbours that it needs."""
    columns = _LINES.split(", ")
    li = table(spark, d, "lineitem").select(*columns, "l_extendedprice")
    return framed(li, columns, 5, 3, {"mean": F.avg("l_quantity"), "dearest": F.max("l_extendedprice")}, block=4096).drop("l_extendedprice").withColumn("mean", F.round("mean", 6))


_FRAME = "OVER (PARTITION BY o_custkey ORDER BY {} ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING EXCLUDE {})"


@query("SELECT o_orderkey, max(o_totalprice) {0} AS most, min(o_totalprice) {0} AS least, array_to_string(list(o_orderkey) {0}, ',') AS others FROM orders".format(_FRAME.format("o_orderdate, o_orderkey", "CURRENT ROW")))
def window_exclude_any(spark, d):
    """EXCLUDE CURRENT ROW for what can't be subtracted."""
    found = excluding(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], 2, 4, "current row", {"most": ("max", "o_totalprice"), "least": ("min", "o_totalprice"), "others": ("list", "o_orderkey")})
    return found.select("o_orderkey", "most", "least", F.when(F.size("others") > 0, F.array_join(F.transform("others", lambda x: x.cast("string")), ",")).alias("others"))


@query("SELECT event_id, count(*) {0} AS n, max(cents) {0} AS most, sum(cents) {0} AS total FROM (SELECT *, round(value * 100)::BIGINT AS cents FROM events)".format("OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) ROWS BETWEEN 90 PRECEDING AND 90 FOLLOWING EXCLUDE GROUP)").replace("sum(cents)", "sum(cents)::DOUBLE").replace("sum(cents)::DOUBLE OVER", "sum(cents::DOUBLE) OVER"))
def window_exclude_group(spark, d):
    """EXCLUDE GROUP: a user's events of other days. Of users with more than 91 events the SQL leaves open which of a day's the frame's edge cuts off: here the event_id decides."""
    e = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("day", "ts").alias("day"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return excluding(e, ["user_id"], [F.col("day")], 90, 90, "group", {"n": ("count", "event_id"), "most": ("max", "cents"), "total": ("sum", "cents")}, (F.col("event_id"),)).select("event_id", "n", "most", "total")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) ROWS BETWEEN 90 PRECEDING AND 90 FOLLOWING EXCLUDE TIES) AS n FROM events")
def window_exclude_ties(spark, d):
    """EXCLUDE TIES, the frame's edges as in window_exclude_group."""
    e = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("day", "ts").alias("day"))
    return excluding(e, ["user_id"], [F.col("day")], 90, 90, "ties", {"n": ("count", "event_id")}, (F.col("event_id"),)).select("event_id", "n")
