"""Aggregates, grouping sets, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rollups import HLL_ERROR, KLL_ERROR, THETA_ERROR, bitmaps, close, distinct_counts, in_common, merged_sketches, sketched
from ..operators.selection import exact_percentiles
from ..operators.skew import distinct_per_group
from ..operators.windows import distinct_on
from ..sources.tables import table, written
from . import query


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS total, min(l_quantity) AS low, max(l_quantity) AS high, round(avg(l_quantity), 4) AS mean FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10")
def agg_basic(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag")
    return g.agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.round(F.avg("l_quantity"), 4).alias("mean")).where("n > 10")


@query("SELECT l_linestatus, count(*) FILTER (WHERE l_quantity > 25) AS large, round(sum(l_tax) FILTER (WHERE l_discount > 0.05), 4) AS tax FROM lineitem GROUP BY l_linestatus")
def agg_filter(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_linestatus")
    return g.agg(F.count_if(F.col("l_quantity") > 25).alias("large"), F.round(F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_tax"))), 4).alias("tax"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, sum(DISTINCT l_linenumber)::BIGINT AS numbers FROM lineitem GROUP BY l_returnflag")
def agg_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"), F.sum_distinct("l_linenumber").alias("numbers"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_distinct_two_steps(spark, d):
    """Distinct counts of a few hot keys, spread over many tasks."""
    return distinct_per_group(table(spark, d, "events"), ["event_type"], "user_id", "users")


_SETS = "l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS g, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY"


def _grouped(g):
    return g.agg(F.grouping("l_returnflag").alias("g"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query(f"SELECT {_SETS} ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark, d):
    return _grouped(table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus"))


@query(f"SELECT {_SETS} CUBE (l_returnflag, l_linestatus)")
def agg_cube(spark, d):
    return _grouped(table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus"))


@query(f"SELECT {_SETS} GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def agg_grouping_sets(spark, d):
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return _grouped(table(spark, d, "lineitem").groupingSets([[a], [b], []], a, b))


@query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus)::BIGINT AS id, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_grouping_id(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("id"), F.count("*").alias("n"))


@query("""
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_discount), 6) AS cov FROM lineitem GROUP BY l_returnflag
""")
def agg_statistics(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("var"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.covar_samp("l_quantity", "l_discount"), 6).alias("cov")
    )


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
def agg_regression(spark, d):
    y, x = "l_extendedprice", "l_quantity"
    return table(spark, d, "lineitem").agg(F.round(F.regr_slope(y, x), 4).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("SELECT l_returnflag, round(median(l_extendedprice), 4) AS mid, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY l_returnflag")
def agg_percentiles(spark, d):
    """Three large groups: by selection, no task holds one."""
    p = exact_percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"mid": 0.5, "p90": 0.9}, large=10_000)
    return p.select("l_returnflag", F.round("mid", 4).alias("mid"), F.round("p90", 4).alias("p90"))


@query("SELECT o_custkey, round(median(o_totalprice), 4) AS mid FROM orders GROUP BY o_custkey")
def agg_percentiles_small(spark, d):
    """Many small groups: each is sorted where it is."""
    return exact_percentiles(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", {"mid": 0.5}).select("o_custkey", F.round("mid", 4).alias("mid"))


@query("SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_custkey")
def agg_max_by(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", "o_totalprice").alias("dearest"), F.min_by("o_orderkey", "o_totalprice").alias("cheapest"))


@query("SELECT lang, bool_and(n_chars > 20) AS every, bool_or(n_chars > 15000) AS some, bit_or(n_chars) AS bits, count_if(n_chars > 1000)::BIGINT AS longer FROM documents GROUP BY lang")
def agg_booleans(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(
        F.bool_and(F.col("n_chars") > 20).alias("every"), F.bool_or(F.col("n_chars") > 15000).alias("some"), F.bit_or("n_chars").alias("bits"), F.count_if(F.col("n_chars") > 1000).alias("longer")
    )


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_listagg(spark, d):
    return table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"))


@query("SELECT n_regionkey, array_to_string(list(n_nationkey ORDER BY n_nationkey), ',') AS keys, len(list(n_name))::INTEGER AS n FROM nation GROUP BY n_regionkey")
def agg_arrays(spark, d):
    g = table(spark, d, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("k"))
    return g.select("n_regionkey", F.array_join(F.transform("k", lambda x: x.cast("string")), ",").alias("keys"), F.size("k").alias("n"))


@query("SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def agg_maps(spark, d):
    """A map built by one aggregate and taken apart again."""
    counts = table(spark, d, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return counts.agg(F.map_from_entries(F.collect_list(F.struct("r_name", "n"))).alias("m")).select(F.explode("m").alias("r_name", "n"))


@query("SELECT l_returnflag, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 2) AS F, round(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 2) AS O FROM lineitem GROUP BY l_returnflag")
def agg_pivot(spark, d):
    """With its values given, a pivot is one aggregate."""
    p = table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))
    return p.select("l_returnflag", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("SELECT s_suppkey, kind, value FROM (SELECT s_suppkey, s_nationkey::DOUBLE AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (value FOR kind IN (nation, balance))")
def agg_unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["nation", "balance"], "kind", "value")


@query("SELECT greatest(0, least(11, floor(l_quantity / 5) + 1))::BIGINT AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def agg_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy(F.width_bucket("l_quantity", F.lit(0.0), F.lit(50.0), F.lit(10)).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id")
def agg_distinct_on(spark, d):
    return distinct_on(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def agg_exact_copies(spark, d):
    """Copies by digest: the shuffle moves 16 bytes a text, not the text."""
    return table(spark, d, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).where("copies > 1")


_DISTINCT = "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY 1"


def _close(spark, d, estimate):
    """Per group the exact count of distinct parts, and whether the estimate is within 6 %."""
    li = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("exact"), estimate.alias("about"))
    return li.select("l_returnflag", "exact", (F.abs(F.col("about") - F.col("exact")) <= 0.06 * F.col("exact")).alias("close"))


@query(_DISTINCT)
def agg_approx_distinct(spark, d):
    return _close(spark, d, F.approx_count_distinct("l_partkey", 0.02))


@query(_DISTINCT)
def agg_hll_sketch(spark, d):
    return _close(spark, d, F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", 12)))


@query(_DISTINCT)
def agg_theta_sketch(spark, d):
    return _close(spark, d, F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey", 12)))


@query("SELECT o_orderstatus, true AS close FROM orders GROUP BY 1")
def agg_approx_percentile(spark, d):
    """The approximate median has about half of its group's rows below it: held against counts, not against an exact percentile."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_totalprice")
    about = o.groupBy(F.col("o_orderstatus").alias("of")).agg(F.percentile_approx("o_totalprice", 0.5, 10000).alias("about"))
    below = o.join(about, F.col("o_orderstatus") == F.col("of")).groupBy("o_orderstatus").agg(F.avg((F.col("o_totalprice") <= F.col("about")).cast("int")).alias("share"))
    return below.select("o_orderstatus", F.col("share").between(0.48, 0.52).alias("close"))


@query("SELECT o_custkey, string_agg(o_orderstatus || o_orderkey, ',' ORDER BY o_orderkey) AS orders, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS dearest FROM orders GROUP BY o_custkey")
def agg_ordered_lists(spark, d):
    """Ordered strings and arrays of every customer."""
    dearest = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey"))), lambda x: x["o_orderkey"])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: F.concat(x["o_orderstatus"], x["o_orderkey"].cast("string")))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(parts, ",").alias("orders"), dearest.alias("dearest"))


@query("SELECT lang, n, n = max(n) OVER () AS is_mode FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def agg_mode(spark, d):
    """The commonest value of a whole table, marked among all values (of several as common, one)."""
    docs = table(spark, d, "documents")
    most = docs.agg(F.mode("lang")).scalar()
    return docs.groupBy("lang").agg(F.count("*").alias("n")).withColumn("is_mode", F.col("lang") == most)


@query("SELECT round(sum(power(l_quantity - m, 3)) / count(*) / power(any_value(s), 3), 6) AS skew, round(sum(power(l_quantity - m, 4)) / count(*) / power(any_value(s), 4) - 3, 6) AS kurt FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem)")
def agg_moments(spark, d):
    """Skewness and excess kurtosis of the population."""
    return table(spark, d, "lineitem").agg(F.round(F.skewness("l_quantity"), 6).alias("skew"), F.round(F.kurtosis("l_quantity"), 6).alias("kurt"))


@query("SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name DESC) AS names, any_value(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def agg_listagg_sql(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return spark.sql("SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name DESC) AS names, any_value(r_name) AS region FROM {both} GROUP BY n_regionkey", both=both)


def _by_day(spark, d):
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return e, written(sketched(e, ["event_type", "day"], "user_id", "value"), "sketches")


@query("SELECT event_type, count(*) AS n, true AS users, true AS users_by_theta, true AS middle, true AS high FROM events GROUP BY event_type")
def agg_sketch_rollup(spark, d):
    """Sketches by day, kept as rows, make those of the whole time: distinct users and ranks within their stated errors."""
    e, days = _by_day(spark, d)
    whole = merged_sketches(days, ["event_type"])
    at = lambda p: F.kll_sketch_get_quantile_double("kll", F.lit(p))
    about = whole.select("event_type", "n", F.hll_sketch_estimate("hll").alias("h"), F.theta_sketch_estimate("theta").alias("t"), at(0.5).alias("m"), at(0.99).alias("p"))
    exact = distinct_per_group(e, ["event_type"], "user_id", "users").withColumnRenamed("event_type", "of")
    held = e.join(F.broadcast(about.select(F.col("event_type").alias("of"), "m", "p")), F.col("event_type") == F.col("of")).groupBy("of").agg(F.avg((F.col("value") <= F.col("m")).cast("double")).alias("below_m"), F.avg((F.col("value") <= F.col("p")).cast("double")).alias("below_p"))
    j = about.join(exact, F.col("event_type") == F.col("of")).drop("of").join(held, F.col("event_type") == F.col("of"))
    near = lambda c, p: F.abs(F.col(c) - p) < KLL_ERROR
    return j.select("event_type", "n", close(F.col("h"), F.col("users"), HLL_ERROR).alias("users"), close(F.col("t"), F.col("users"), THETA_ERROR).alias("users_by_theta"), near("below_m", 0.5).alias("middle"), near("below_p", 0.99).alias("high"))


@query("SELECT day, true AS common FROM (SELECT DISTINCT date_trunc('day', ts)::TIMESTAMP AS day, event_type FROM events WHERE event_type IN ('view', 'purchase')) GROUP BY day HAVING count(*) = 2")
def agg_sketch_intersection(spark, d):
    """Users who both viewed and bought on a day, from the two sketches of the day alone."""
    e, days = _by_day(spark, d)
    of = lambda k: days.where(F.col("event_type") == k)
    about = in_common(of("view"), of("purchase"), ["day"])
    users = e.where("event_type IN ('view', 'purchase')").groupBy("day", "user_id").agg(F.count_distinct("event_type").alias("k"))
    exact = users.groupBy(F.col("day").alias("of")).agg(F.count_if(F.col("k") == 2).alias("exact"), F.count("*").alias("any"))
    # an intersection is off by the error of the union
    return about.join(exact, F.col("day") == F.col("of")).select("day", (F.abs(F.col("common") - F.col("exact")) <= F.greatest(THETA_ERROR * F.col("any"), F.lit(1.0))).alias("common"))


@query("""
    SELECT event_type, month, CASE WHEN event_type IS NOT NULL AND month IS NOT NULL THEN 0 WHEN event_type IS NOT NULL THEN 1 ELSE 2 END AS "grouping", count(DISTINCT user_id) AS n
    FROM (SELECT *, date_trunc('month', ts)::TIMESTAMP AS month FROM events) GROUP BY GROUPING SETS ((event_type, month), (event_type), ())
""")
def agg_bitmap_rollup(spark, d):
    """Exact distinct users by type and month, by type, and of all, from bitmaps by type and day: the rows are read once."""
    e = table(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    days = written(bitmaps(e, ["event_type", "day"], "user_id"), "bitmaps").withColumn("month", F.date_trunc("month", "day").cast("timestamp_ntz"))
    return distinct_counts(days, ["event_type", "month"], ["event_type"], [])
