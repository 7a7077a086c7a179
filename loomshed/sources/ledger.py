"""A data source in Python: Parquet files under a ledger that names what is committed, to read, to write and to stream.

Tasks write files that nobody reads yet; the driver's commit adds one numbered entry to the ledger that names them all, or an abort
removes them. What the ledger names is read, by file; so a task that is run again, or a job that fails, leaves no row twice and none by halves. An entry's number is
the offset of a stream. Filters on columns reach the files' reader. Paths are those that pyarrow opens on every node.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage


def register(spark: SparkSession) -> None:
    """format("ledger") with a path; option schema in DDL to read.

    The classes are made here so that they travel to the workers as they are, whether or not those can import this package.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

    def opened(path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def entries(path: str, after: int = 0, upto: int | None = None) -> list[str]:
        """Files that the ledger's entries after one and up to another name."""
        store, root = opened(path)
        found: list[str] = []
        for k in range(after, count(path) if upto is None else upto):
            with store.open_input_stream(f"{root}/_ledger/{k:09d}") as f:
                found += f.read().decode().split()
        return found

    def count(path: str) -> int:
        from pyarrow import fs

        store, root = opened(path)
        return sum(x.base_name.isdigit() for x in store.get_file_info(fs.FileSelector(f"{root}/_ledger", allow_not_found=True)))

    def batches(path: str, name: str, columns: list[str], tests: list | None = None) -> Iterator:
        import pyarrow.dataset as ds

        store, root = opened(path)
        kept = None
        for column, op, value in tests or []:
            f = ds.field(column)
            test = {"=": f == value, "<": f < value, "<=": f <= value, ">": f > value, ">=": f >= value}[op] if op != "in" else f.isin(list(value))
            kept = test if kept is None else kept & test
        yield from ds.dataset(f"{root}/{name}", filesystem=store, format="parquet").to_batches(columns=columns, filter=kept)

    class Reader(DataSourceReader):
        def __init__(self, path: str, schema):
            self.path, self.columns, self.tests = path, schema.fieldNames(), []

        def pushFilters(self, filters):
            ops = {EqualTo: "=", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">=", In: "in"}
            for f in filters:
                if type(f) in ops and len(f.attribute) == 1 and f.value is not None:
                    self.tests.append((f.attribute[0], ops[type(f)], f.value))
                else:
                    yield f

        def partitions(self) -> list[InputPartition]:
            return [InputPartition(name) for name in entries(self.path)]

        def read(self, partition: InputPartition) -> Iterator:
            yield from batches(self.path, partition.value, self.columns, self.tests)

    class StreamReader(DataSourceStreamReader):
        def __init__(self, path: str, schema):
            self.path, self.columns = path, schema.fieldNames()

        def initialOffset(self) -> dict:
            return {"entries": 0}

        def latestOffset(self) -> dict:
            return {"entries": count(self.path)}

        def partitions(self, start: dict, end: dict) -> list[InputPartition]:
            return [InputPartition(name) for name in entries(self.path, start["entries"], end["entries"])]

        def read(self, partition: InputPartition) -> Iterator:
            yield from batches(self.path, partition.value, self.columns)

        def commit(self, end: dict) -> None:
            pass

    class Writer(DataSourceArrowWriter):
        def __init__(self, path: str):
            self.path = path

        def write(self, iterator: Iterator) -> WriterCommitMessage:
            import uuid

            import pyarrow.parquet as pq

            store, root = opened(self.path)
            store.create_dir(root, recursive=True)
            name, out = f"{uuid.uuid4().hex}.parquet", None
            for batch in iterator:
                out = out or pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=store)
                out.write_batch(batch)
            if out:
                out.close()
            message = WriterCommitMessage()
            message.name = name if out else None
            return message

        def commit(self, messages: list) -> None:
            store, root = opened(self.path)
            store.create_dir(f"{root}/_ledger", recursive=True)
            names = [m.name for m in messages if m and m.name]
            with store.open_output_stream(f"{root}/_new") as f:
                f.write("\n".join(names).encode())
            store.move(f"{root}/_new", f"{root}/_ledger/{count(self.path):09d}")

        def abort(self, messages: list) -> None:
            store, root = opened(self.path)
            for m in messages:
                if m and m.name:
                    store.delete_file(f"{root}/{m.name}")

    class Ledger(DataSource):
        @classmethod
        def name(cls) -> str:
            return "ledger"

        def schema(self) -> str:
            return self.options["schema"]

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options["path"], schema)

        def streamReader(self, schema) -> DataSourceStreamReader:
            return StreamReader(self.options["path"], schema)

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            if overwrite:
                raise ValueError("a ledger is only added to")
            return Writer(self.options["path"])

    spark.dataSource.register(Ledger)
