"""Tables of a data folder, and files in the formats that Spark brings along."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "json", "csv", "xml")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; the warehouse where no such folder is set and all run in one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    shared = shared or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/loomshed-{name}-{uuid.uuid4().hex}"


def write_files(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "error") -> str:
    """Write df in one of FORMATS or as text; partition columns become folders, so that reads can skip them."""
    writer = df.write.mode(mode).format(kind)
    if kind == "xml":
        writer = writer.option("rowTag", "row")
    if kind == "csv":
        writer = writer.option("header", "true").option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
    return path


def read_files(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """Always with a schema: inferring one would read the data twice."""
    reader = spark.read.schema(schema).format(kind)
    if kind == "xml":
        reader = reader.option("rowTag", "row")
    if kind == "csv":
        reader = reader.option("header", "true").option("escape", '"')
    return reader.load(path)


def round_trip(df: DataFrame, kind: str) -> DataFrame:
    """df written in a format and read again."""
    spark = df.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return read_files(spark, write_files(df, scratch(spark, kind), kind), schema, kind)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its rows and their partitions stay as they are, and lost executors cost nothing of it."""
    return df.sparkSession.read.schema(df.schema).parquet(write_files(df, scratch(df.sparkSession, name)))
