"""Projections, filters, predicates and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fixpoint import hops
from ..operators.subqueries import not_in
from ..sources.tables import table, written
from . import query


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity > 40")
def filter_project(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") > 40))
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"))


@query("SELECT p_partkey, CASE WHEN p_size < 15 THEN 'small' WHEN p_size < 35 THEN 'medium' ELSE 'large' END AS size FROM part WHERE p_size BETWEEN 5 AND 45 AND p_brand LIKE 'Brand#1%'")
def filter_between_like_case(spark, d):
    p = table(spark, d, "part").where(F.col("p_size").between(5, 45) & F.col("p_brand").like("Brand#1%"))
    return p.select("p_partkey", F.when(F.col("p_size") < 15, "small").when(F.col("p_size") < 35, "medium").otherwise("large").alias("size"))


@query("SELECT doc_id, lang FROM documents WHERE text ILIKE '%license%' OR regexp_matches(text, '[0-9]{3}-[0-9]{4}') OR starts_with(text, 'Th') OR contains(text, 'www.')")
def filter_text_predicates(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where(t.ilike("%license%") | t.rlike("[0-9]{3}-[0-9]{4}") | t.startswith("Th") | t.contains("www.")).select("doc_id", "lang")


@query("""
    SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality, nullif(l.toxic, 0)::INTEGER AS toxic, (l.quality IS DISTINCT FROM 1) AS differs
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def filter_nulls(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.nullif(F.col("toxic"), F.lit(0)).alias("toxic"), (~F.col("quality").eqNullSafe(F.lit(1))).alias("differs"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def subquery_scalar(spark, d):
    o = table(spark, d, "orders")
    return o.where(F.col("o_totalprice") > o.agg(F.avg("o_totalprice") * 1.5).scalar()).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey) AND o_orderstatus = 'O'")
def subquery_correlated(spark, d):
    """The correlated average, as one aggregate joined by its key."""
    o = table(spark, d, "orders")
    means = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean"))
    return o.where("o_orderstatus = 'O'").join(means, "o_custkey").where("o_totalprice > mean").select("o_orderkey", "o_custkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def subquery_not_in(spark, d):
    return not_in(table(spark, d, "documents"), "doc_id", table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) WHERE c_mktsegment = 'MACHINERY'")
def subquery_lateral(spark, d):
    c, o = table(spark, d, "customer").where("c_mktsegment = 'MACHINERY'"), table(spark, d, "orders")
    best = o.where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")
    return c.lateralJoin(best).select("c_custkey", "o_orderkey", "o_totalprice")


_EDGES = """
    edges AS (SELECT DISTINCT 'c' || o_custkey AS a, 's' || l_suppkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P' AND l_quantity >= 45),
    ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)
"""


@query(f"""
    WITH RECURSIVE {_EDGES}, seeds AS (SELECT 'c' || min(c_custkey) AS node FROM customer GROUP BY c_nationkey),
    walk(node, hops) AS (SELECT node, 0 FROM seeds UNION SELECT b, hops + 1 FROM walk JOIN ways ON a = node WHERE hops < 40)
    SELECT node, min(hops)::INTEGER AS hops FROM walk GROUP BY node
""")
def recursive_hops(spark, d):
    """Customers and suppliers by the least number of steps from each nation's first customer, over who bought from whom: rounds of joins until nothing is new."""
    o, li = table(spark, d, "orders").where("o_orderstatus = 'P'"), table(spark, d, "lineitem").where("l_quantity >= 45")
    edges = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")).distinct()
    both = written(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    seeds = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("k")).select(F.concat(F.lit("c"), "k").alias("node"))
    return hops(both, seeds)


_CHAIN = "WITH RECURSIVE chain(k, hops) AS (SELECT c_custkey, 0 FROM {0} WHERE c_custkey < 25 UNION ALL SELECT 2 * c_custkey + 1, hops + 1 FROM chain JOIN {0} ON c_custkey = k WHERE hops < 12) SELECT k, hops FROM chain"


@query(_CHAIN.format("customer"))
def recursive_cte(spark, d):
    """Spark's own recursion in SQL, over a table: keys that double as long as there is a customer of that key."""
    return spark.sql(_CHAIN.format("{customer}"), customer=table(spark, d, "customer"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 10 GROUP BY event_type")
def pipe_syntax(spark, d):
    return spark.sql("FROM {events} |> WHERE value > 10 |> AGGREGATE count(*) AS n GROUP BY event_type", events=table(spark, d, "events"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def sort_limit_offset(spark, d):
    """A top-k: each task keeps its best rows, no task sorts everything."""
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10).select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, quality FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ORDER BY quality ASC NULLS LAST, doc_id LIMIT 50")
def sort_nulls_last(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.orderBy(F.asc_nulls_last("quality"), "doc_id").limit(50).select("doc_id", "quality")


@query("SELECT o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::INTEGER AS done, o_totalprice::BIGINT AS whole FROM (SELECT o_orderkey, o_orderstatus, trunc(o_totalprice) AS o_totalprice FROM orders)")
def cast_and_flags(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("done"), F.col("o_totalprice").cast("bigint").alias("whole"))


@query()
def sample_rows(spark, d):
    """A tenth of the rows, by a seed; sampling is the feature."""
    return table(spark, d, "lineitem").sample(fraction=0.1, seed=7)


@query("SELECT o_orderkey, ifnull(nullif(o_orderstatus, 'O'), 'open') AS status, NULL || 'a' IS NULL AS nothing, 'b' || o_orderstatus AS both FROM orders")
def filter_ifnull_concat(spark, d):
    """concat with a null is null, as || is in either dialect."""
    status = F.ifnull(F.nullif("o_orderstatus", F.lit("O")), F.lit("open"))
    return table(spark, d, "orders").select("o_orderkey", status.alias("status"), F.concat(F.lit(None).cast("string"), F.lit("a")).isNull().alias("nothing"), F.concat(F.lit("b"), "o_orderstatus").alias("both"))


@query("SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT CASE WHEN doc_id > 50 THEN doc_id END FROM labels)")
def subquery_not_in_null(spark, d):
    """A null in the list leaves no row: what is unknown isn't false."""
    some = table(spark, d, "labels").select(F.when(F.col("doc_id") > 50, F.col("doc_id")).alias("doc_id"))
    return not_in(table(spark, d, "documents"), "doc_id", some, "doc_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P') AND o_orderstatus <> 'P'")
def subquery_all(spark, d):
    """>= ALL is >= the greatest."""
    o = table(spark, d, "orders")
    return o.where((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") >= o.where("o_orderstatus = 'P'").agg(F.max("o_totalprice")).scalar())).select("o_orderkey")


@query("SELECT * FROM (SELECT l_shipdate, l_quantity FROM lineitem) WHERE l_shipdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1996-03-31' AND l_quantity IN (1, 2, 3)")
def filter_dates(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate BETWEEN TIMESTAMP_NTZ '1996-03-01' AND TIMESTAMP_NTZ '1996-03-31' AND l_quantity IN (1, 2, 3)").select("l_shipdate", "l_quantity")
