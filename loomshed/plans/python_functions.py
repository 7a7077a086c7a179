"""Functions in Python: by row, by Arrow batch, by group, as tables; and functions in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.two_phase import trimmed_means
from ..sources import ledger
from ..sources.tables import scratch, table
from . import query


@query("SELECT n_nationkey, upper(n_name) || '!' AS loud FROM nation")
def udf_row(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.udf(lambda s: s.upper() + "!", "string")("n_name").alias("loud"))


@query("SELECT n_nationkey, length(n_name) * 2 AS twice FROM nation")
def udf_arrow(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.udf(lambda s: len(s) * 2, "bigint", useArrow=True)("n_name").alias("twice"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice * 1.1, 3) AS scaled FROM lineitem")
def udf_pandas(spark, d):
    @F.pandas_udf("double")
    def scaled(s: pd.Series) -> pd.Series:
        return s * 1.1

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(scaled("l_extendedprice"), 3).alias("scaled"))


@query("SELECT o_custkey, round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders GROUP BY o_custkey")
def udaf_pandas(spark, d):
    """A group is one series, so this is for keys of many groups; max and min themselves are built in."""

    @F.pandas_udf("double")
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(spread("o_totalprice"), 2).alias("spread"))


@query("SELECT o_orderkey, o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey) > 0.005 AS above FROM orders")
def grouped_map_pandas(spark, d):
    def above(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"o_orderkey": g.o_orderkey, "above": g.o_totalprice - g.o_totalprice.mean() > 0.005})

    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice").groupBy("o_custkey").applyInPandas(above, "o_orderkey bigint, above boolean")


@query("SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY o_custkey")
def grouped_map_arrow(spark, d):
    def top(t: pa.Table) -> pa.Table:
        return pa.table({"o_custkey": t.column("o_custkey").slice(0, 1), "n": [t.num_rows], "top": [pc.max(t.column("o_totalprice")).as_py()]})

    g = table(spark, d, "orders").select("o_custkey", "o_totalprice").groupBy("o_custkey").applyInArrow(top, "o_custkey bigint, n bigint, top double")
    return g.withColumn("top", F.round("top", 2))


@query("""
    SELECT coalesce(o_custkey, user_id) AS key, coalesce(o, 0) AS orders, coalesce(e, 0) AS events
    FROM (SELECT o_custkey, count(*) AS o FROM orders GROUP BY 1) FULL JOIN (SELECT user_id, count(*) AS e FROM events GROUP BY 1) ON o_custkey = user_id
""")
def cogrouped_map_pandas(spark, d):
    def both(key, o: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "orders": [len(o)], "events": [len(e)]})

    o, e = table(spark, d, "orders").select("o_custkey"), table(spark, d, "events").select("user_id")
    return o.groupBy("o_custkey").cogroup(e.groupBy("user_id")).applyInPandas(both, "key bigint, orders bigint, events bigint")


@query("SELECT doc_id, length(text) - length(replace(text, ' ', '')) AS blanks FROM documents")
def map_pandas(spark, d):
    def blanks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "blanks": b.text.str.count(" ")})

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(blanks, "doc_id bigint, blanks bigint")


@query("SELECT doc_id, strlen(text) AS bytes FROM documents")
def map_arrow(spark, d):
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.cast(pc.binary_length(b.column(1)), pa.int64())], names=["doc_id", "bytes"])

    return table(spark, d, "documents").select("doc_id", "text").mapInArrow(size, "doc_id bigint, bytes bigint")


@query("SELECT n_nationkey, unnest(string_split(n_name, ' ')) AS word FROM nation")
def udtf_words(spark, d):
    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in text.split(" "):
                yield (w,)

    spark.udtf.register("loomshed_words", Words)
    return spark.sql("SELECT n_nationkey, word FROM {nation}, LATERAL loomshed_words(n_name)", nation=table(spark, d, "nation"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def udf_sql(spark, d):
    """A function in SQL is inlined: it costs what its body costs."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION loomshed_net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.expr("loomshed_net(l_extendedprice, l_discount)").alias("net"))


@query("SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click' AND value >= 5")
def python_source(spark, d):
    """The events through a source in Python: written under a ledger, committed as a whole, read by file with the filters pushed into the files."""
    ledger.register(spark)
    e, path = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value"), scratch(spark, "ledger")
    e.write.format("ledger").mode("append").save(path)
    back = spark.read.format("ledger").option("schema", "event_id bigint, user_id bigint, ts timestamp_ntz, event_type string, value double").load(path)
    return back.where("event_type = 'click' AND value >= 5").select("event_id", "user_id", "ts", "value")


@query("SELECT o_orderkey, round(max(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice, 2) AS below FROM orders")
def udaf_window(spark, d):
    """An aggregate in pandas over a window."""

    @F.pandas_udf("double")
    def most(s: pd.Series) -> float:
        return float(s.max())

    return table(spark, d, "orders").select("o_orderkey", F.round(most("o_totalprice").over(Window.partitionBy("o_custkey")) - F.col("o_totalprice"), 2).alias("below"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def udtf_api(spark, d):
    """A table function called from Python over a whole table."""

    @F.udtf(returnType="n_regionkey int, n bigint")
    class Count:
        def __init__(self):
            self.key, self.n = None, 0

        def eval(self, row):
            self.key, self.n = row["n_regionkey"], self.n + 1

        def terminate(self):
            yield self.key, self.n

    return Count(table(spark, d, "nation").asTable().partitionBy("n_regionkey"))


@query("""
    WITH cut AS (SELECT l_returnflag AS flag, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
    SELECT flag AS l_returnflag, max(n) AS n, round(avg(q) FILTER (WHERE k > floor(0.1 * n) AND k <= n - floor(0.1 * n)), 6) AS trimmed FROM cut GROUP BY flag
""")
def udaf_two_phase(spark, d):
    """An aggregate that isn't built in, over three large groups: histograms by task, summed, finished from the histogram."""
    return trimmed_means(table(spark, d, "lineitem"), "l_returnflag", "l_quantity", 0.1, 1.0).withColumn("trimmed", F.round("trimmed", 6))
