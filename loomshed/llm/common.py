"""What the operators share: materialised tables, Python on the executors, words."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from pathlib import Path
from typing import ClassVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 8 << 20
#: Spark's setting by which a query's shuffle files go when it ends; else when the driver's garbage is collected.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most bytes of a table that is sent to all executors.
MOST_SENT = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see; a temporary one only where none is set and all run in one process (tests)."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf and not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if not conf:
        conf = "file://" + tempfile.mkdtemp(prefix="loomshed-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


class Scratch:
    """Tables written to the shared folder. They cut lineage and outlive lost executors; `clear` removes them when results are written down."""

    made: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        Scratch.made.append(self)
        self.spark, self.root, self.tables = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", []
        #: Whether the shuffle files behind a table go as soon as it is written.
        self.brief = False

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.tables.append(name)
        before = self.spark.conf.get(FILES_GO, None)
        if self.brief:
            self.spark.conf.set(FILES_GO, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            if self.brief:
                self.spark.conf.unset(FILES_GO) if before is None else self.spark.conf.set(FILES_GO, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        self.tables = [t for t in self.tables if t not in names]
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Let Spark remove the shuffle files of jobs whose results are written down: it does when the driver's garbage is collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def keep(self, before: int, *names: str) -> None:
        """Of the tables made since there were `before`, remove all but those that the result still reads."""
        self.drop(*(t for t in self.tables[before:] if t not in names))


def clear(since: int = 0, but: Scratch | None = None) -> None:
    """Remove the folders of all scratch tables that this driver has made after the first `since`, but one: what reads them is worthless then."""
    gone = [s for s in Scratch.made[since:] if s is not but]
    for s in gone:
        s.drop("")
        Scratch.made.remove(s)


def as_text(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def held_out(doc_id: int | None, mod: int, rest: int) -> bool:
    """Whether crc32(doc_id as text) mod `mod` is `rest`; a null doc_id counts as empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod == rest


def held_out_col(doc_id: str, mod: int, rest: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == rest


def words_of(text: str) -> list[bytes]:
    """bytes.split() cuts at exactly the six characters of SPACES."""
    return text.encode("utf-8", "surrogatepass").split()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in runs of about `most` bytes of text, so that a task's memory doesn't follow its batches."""
    for batch in batches:
        at, size = 0, 0
        lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
        for k, n in enumerate(lengths):
            if size and size + (n or 0) > most:
                yield batch.slice(at, k - at)
                at, size = k, 0
            size += n or 0
        if at < len(lengths):
            yield batch.slice(at)


def small(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df, to be broadcast only if it has been counted and is under MOST_SENT; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() * bytes_a_row <= MOST_SENT else df
