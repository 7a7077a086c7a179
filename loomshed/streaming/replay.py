"""Tables as streams, and streams run to their end."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.tables import scratch, table


def event_stream(spark: SparkSession, folder: str, batches: int = 4, files: int = 2) -> DataFrame:
    """The events in order of time, `files` files per batch. Watermarks need a time zone: ts becomes a timestamp in the session's."""
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    # cut by time itself: ids need not follow it, and rows of a later batch would be late; rows without a time come first
    at = F.coalesce(F.unix_micros("ts").cast("double"), F.lit(float("-inf")))
    bounds = events.select(F.unix_micros("ts").cast("double").alias("at")).stat.approxQuantile("at", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    edges = [None, *bounds, None] if bounds else [None, None]
    within = lambda low, high: (F.lit(True) if low is None else at > low) & (F.lit(True) if high is None else at <= high)
    return replayed(spark, [events.where(within(low, high)) for low, high in zip(edges, edges[1:], strict=False)], files)


def replayed(spark: SparkSession, parts: list[DataFrame], files: int = 1) -> DataFrame:
    """The parts as a stream of a batch each."""
    path = scratch(spark, "stream")
    for part in parts:  # files are taken by age, so each part is written after the one before
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def collected(stream: DataFrame, mode: str, **options: str) -> DataFrame:
    """The rows that the stream has put out when all its input is used: of complete mode the last batch's, else all.

    The executors write each batch to a folder of its own number; a batch that is run again overwrites itself.
    """
    spark, path = stream.sparkSession, scratch(stream.sparkSession, "batches")
    whole = StructType([*stream.schema.fields, StructField("batch", LongType())])
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    last = [-1]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[0] = number

    run = stream.writeStream.foreachBatch(write).outputMode(mode).options(checkpointLocation=scratch(spark, "progress"), **options).trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.schema(whole).parquet(path)
    return (rows.where(rows.batch == last[0]) if mode == "complete" else rows).drop("batch")


class Stopped(RuntimeError):
    """What stands for the loss of the driver in the middle of a batch."""


def restarted(stream: DataFrame, mode: str, stops: tuple[int, ...]) -> tuple[DataFrame, list[int]]:
    """What the stream puts out if it is lost in each batch of `stops`, after the batch's rows are written and before the batch is committed, and is
    started again from the same checkpoint; and the batches in the order in which they were written.

    The batch that was lost is run again from the offsets and the state that the checkpoint holds, and overwrites its own folder.
    """
    spark, path, progress = stream.sparkSession, scratch(stream.sparkSession, "batches"), scratch(stream.sparkSession, "progress")
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    written, left = [], list(stops)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        written.append(number)
        if number in left:
            left.remove(number)
            raise Stopped(number)

    while True:
        before = len(left)
        run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", progress).trigger(availableNow=True).start()
        try:
            run.awaitTermination()
            break
        except StreamingQueryException:
            if len(left) == before:  # another error than ours
                raise
    whole = StructType([*stream.schema.fields, StructField("batch", LongType())])
    return spark.read.schema(whole).parquet(path).drop("batch"), written


def filed(stream: DataFrame, runs: int = 1) -> DataFrame:
    """The stream's rows through Spark's own file sink, whose log names each batch's files once; started `runs` times from one checkpoint."""
    path, progress = scratch(stream.sparkSession, "filed"), scratch(stream.sparkSession, "progress")
    for _ in range(runs):
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
