"""Set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from . import query

_A, _B = "SELECT doc_id FROM documents", "SELECT doc_id + 300 AS doc_id FROM labels"


def _sides(spark, d):
    return table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").selectExpr("doc_id + 300 AS doc_id")


@query(f"{_A} UNION {_B}")
def set_union(spark, d):
    a, b = _sides(spark, d)
    return a.union(b).distinct()


@query(f"{_A} UNION ALL {_B}")
def set_union_all(spark, d):
    a, b = _sides(spark, d)
    return a.union(b)


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, d):
    a, b = _sides(spark, d)
    return a.intersect(b)


@query("SELECT o_orderpriority AS x FROM orders INTERSECT ALL SELECT o_orderpriority AS x FROM orders WHERE o_orderstatus = 'F'")
def set_intersect_all(spark, d):
    o = table(spark, d, "orders")
    return o.selectExpr("o_orderpriority AS x").intersectAll(o.where("o_orderstatus = 'F'").selectExpr("o_orderpriority AS x"))


@query(f"{_A} EXCEPT {_B}")
def set_except(spark, d):
    a, b = _sides(spark, d)
    return a.subtract(b)


@query("SELECT o_orderpriority AS x FROM orders EXCEPT ALL SELECT o_orderpriority AS x FROM orders WHERE o_orderstatus = 'F'")
def set_except_all(spark, d):
    o = table(spark, d, "orders")
    return o.selectExpr("o_orderpriority AS x").exceptAll(o.where("o_orderstatus = 'F'").selectExpr("o_orderpriority AS x"))


@query("SELECT n_name AS name, n_nationkey AS nation, NULL::INTEGER AS region FROM nation UNION ALL SELECT r_name, NULL, r_regionkey FROM region")
def set_union_by_name(spark, d):
    n = table(spark, d, "nation").selectExpr("n_name AS name", "n_nationkey AS nation")
    return n.unionByName(table(spark, d, "region").selectExpr("r_regionkey AS region", "r_name AS name"), allowMissingColumns=True)


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def set_distinct(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderstatus").distinct()


@query("SELECT v, count(*) AS n FROM orders JOIN (VALUES ('F', 'finished'), ('O', 'open'), ('X', NULL)) t(k, v) ON o_orderstatus = k GROUP BY v")
def values_rows(spark, d):
    """Literal rows beside a table."""
    named = spark.sql("SELECT * FROM VALUES ('F', 'finished'), ('O', 'open'), ('X', NULL) t(k, v)")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")).join(named, F.col("o_orderstatus") == F.col("k")).groupBy("v").agg(F.sum("n").alias("n"))


@query("""
    SELECT r.range AS doc_id, count(l.doc_id) AS labelled FROM range((SELECT max(doc_id) + 1 FROM documents)) r LEFT JOIN labels l ON l.doc_id = r.range GROUP BY r.range
""")
def range_rows(spark, d):
    """All numbers up to the table's greatest, made in tasks, beside those that another table has."""
    last = table(spark, d, "documents").agg(F.max("doc_id")).first()[0]
    ids = spark.range(0 if last is None else last + 1)
    return ids.join(table(spark, d, "labels").select("doc_id"), F.col("id") == F.col("doc_id"), "left").groupBy("id").agg(F.count("doc_id").alias("labelled")).withColumnRenamed("id", "doc_id")
