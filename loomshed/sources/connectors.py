"""Sources whose connectors Spark loads from packages: they need those on the class path, and say so if they are missing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

PACKAGES = {"avro": "org.apache.spark:spark-avro", "kafka": "org.apache.spark:spark-sql-kafka-0-10"}


class MissingConnector(RuntimeError):
    pass


def _loaded(reader, kind: str, *path: str) -> DataFrame:
    try:
        return reader.format(kind).load(*path)
    except AnalysisException as e:
        if kind in PACKAGES and "find" in str(e).lower():
            raise MissingConnector(f"format {kind!r} needs --packages {PACKAGES[kind]}") from e
        raise


def read_avro(spark: SparkSession, path: str) -> DataFrame:
    return _loaded(spark.read, "avro", path)


def read_kafka(spark: SparkSession, servers: str, topic: str, stream: bool = False, **options: str) -> DataFrame:
    """Rows of a topic with key and value as strings; as a stream, or all that is there."""
    reader = (spark.readStream if stream else spark.read).options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options})
    return _loaded(reader, "kafka").selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value", "partition", "offset", "timestamp")


def read_jdbc(spark: SparkSession, url: str, dbtable: str, column: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table over a driver of one's own, read by `partitions` tasks that each ask for a range of `column`.

    Rows outside low .. high are read too, by the first and the last task. Filters and columns are pushed to the database.
    """
    reader = spark.read.options(url=url, dbtable=dbtable, partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options)
    return _loaded(reader, "jdbc")
