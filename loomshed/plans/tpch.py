"""Star-schema reports over several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from . import query


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1995-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10
""")
def tpch_shipping_priority(spark, d):
    """The ten open orders of a segment with the most revenue."""
    c = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = table(spark, d, "orders").where("o_orderdate < TIMESTAMP_NTZ '1998-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, d, "lineitem").where("l_shipdate > TIMESTAMP_NTZ '1995-03-15'").select("l_orderkey", _revenue().alias("r"))
    sums = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum("r"), 2).alias("revenue"))
    return sums.orderBy(F.desc("revenue"), "l_orderkey").limit(10).select("l_orderkey", "revenue", "o_orderdate")


@query("""
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
      round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
      round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""")
def tpch_pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(_revenue()), 2).alias("sum_disc"),
        F.round(F.sum(_revenue() * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name
""")
def tpch_local_suppliers(spark, d):
    """Revenue by nation where customer and supplier are of one nation: six tables."""
    nations = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    s = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    li = table(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey", "n_name", _revenue().alias("r"))
    oc = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    return li.join(oc, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey"))).groupBy("n_name").agg(F.round(F.sum("r"), 2).alias("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24")
def tpch_forecast_revenue(spark, d):
    """A scan whose filters reach the files."""
    li = table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP_NTZ '1994-01-01' AND l_shipdate < TIMESTAMP_NTZ '1995-01-01' AND l_discount BETWEEN 0.03D AND 0.07D AND l_quantity < 24")
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("""
    SELECT o_orderpriority, count(*) AS n FROM orders
    WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority
""")
def tpch_order_priority(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    return o.join(li, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") > F.col("o_orderdate")), "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("""
    SELECT s_suppkey, s_name, round(r, 2) AS total FROM supplier JOIN (SELECT l_suppkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
    QUALIFY rank() OVER (ORDER BY round(r, 2) DESC) <= 3
""")
def tpch_top_suppliers(spark, d):
    sums = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(_revenue()), 2).alias("total"))
    best = sums.orderBy(F.desc("total")).limit(3).agg(F.min("total")).scalar()  # a top-k, not a sort of everything
    return sums.where(F.col("total") >= best).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", "total")


@query("""
    SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS spent, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey
    GROUP BY ALL HAVING count(*) >= 15
""")
def tpch_large_customers(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("n")).where("n >= 15")
    return o.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "c_name", "spent", "n")


@query("""
    SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size BETWEEN 10 AND 20 GROUP BY ALL
""")
def tpch_parts_suppliers(spark, d):
    p = table(spark, d, "part").where("p_size BETWEEN 10 AND 20").select("p_partkey", "p_brand", "p_type")
    return table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_type").agg(F.count_distinct("l_suppkey").alias("suppliers"))
