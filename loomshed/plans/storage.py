"""Tables written in a format and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import read_files, round_trip, scratch, table, write_files
from . import query

_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


@query("SELECT * FROM orders")
def format_parquet(spark, d):
    return round_trip(table(spark, d, "orders"), "parquet")


@query("SELECT * FROM customer")
def format_orc(spark, d):
    return round_trip(table(spark, d, "customer"), "orc")


@query("SELECT conv_id, turn, role, text FROM conversations")
def format_json(spark, d):
    return round_trip(table(spark, d, "conversations"), "json")


@query("SELECT * FROM supplier")
def format_csv(spark, d):
    return round_trip(table(spark, d, "supplier"), "csv")


@query(_NATION)
def format_xml(spark, d):
    return round_trip(table(spark, d, "nation"), "xml")


@query("SELECT r_name AS value FROM region")
def format_text(spark, d):
    path = write_files(table(spark, d, "region").select(F.col("r_name").alias("value")), scratch(spark, "text"), "text")
    return spark.read.text(path)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 2 = 0")
def partitioned_read(spark, d):
    """Written into a folder per status; the filter reads one of them."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = write_files(o.repartition("o_orderstatus"), scratch(spark, "parts"), partition_by=("o_orderstatus",))
    return read_files(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderstatus string").where("o_orderstatus = 'F' AND o_orderkey % 2 = 0").select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey")
def bucketed_join(spark, d):
    """Both tables bucketed by the key: the join and the aggregate need no shuffle."""
    for name, key, columns in (("orders", "o_custkey", ["o_custkey", "o_orderkey"]), ("customer", "c_custkey", ["c_custkey"])):
        table(spark, d, name).select(*columns).write.mode("overwrite").option("path", scratch(spark, f"bucketed-{name}")).bucketBy(8, key).sortBy(key).saveAsTable(f"loomshed_bucketed_{name}")
    o, c = spark.table("loomshed_bucketed_orders"), spark.table("loomshed_bucketed_customer")
    return o.join(c.hint("merge"), F.col("o_custkey") == F.col("c_custkey")).groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey FROM orders JOIN (SELECT DISTINCT o_orderpriority AS p, o_orderstatus AS s FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 499000) ON s = o_orderstatus")
def partition_pruning_by_join(spark, d):
    """What the other side of a join finds out at run time decides which folders are read."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    path = write_files(o.repartition("o_orderstatus"), scratch(spark, "pruned"), partition_by=("o_orderstatus",))
    facts = read_files(spark, path, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_totalprice double, o_orderstatus string")
    wanted = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 499000").select(F.col("o_orderstatus").alias("s")).distinct()
    return facts.join(F.broadcast(wanted), F.col("o_orderstatus") == F.col("s")).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS price, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_totalprice > 1000")
def partition_overwrite(spark, d):
    """A second write replaces just the folders that it has rows for."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    path = write_files(o.repartition("o_orderstatus"), scratch(spark, "replaced"), partition_by=("o_orderstatus",))
    again = o.where("o_orderstatus = 'F' AND price > 1000").withColumn("price", -F.col("price")).repartition("o_orderstatus")
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("o_orderstatus").parquet(path)
    return read_files(spark, path, "o_orderkey bigint, price double, o_orderstatus string")
