"""WARC archives, each compressed with a dictionary built from its own records, and what reads them back.

An archive is a file of Zstandard frames: first a skippable frame that holds the dictionary, then one frame for each record,
so that any record can be read by itself with the dictionary at hand. Payloads that are the same are stored once: the
others are revisit records, which name the response they repeat.

A task gathers records up to `archive_bytes`, trains a dictionary on pieces spread over all of them and compresses
each. A whole archive is one value, and Spark's own text writer puts it into a file of its own: what it writes after each value,
the line's end, is an empty skippable frame here. So archives are committed as any of Spark's files are, to any store that Spark
writes to, and a task that is run again leaves no half of a file behind.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_text, prepare, slices, small

#: Fixed values of the WARC and Zstandard formats.
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DICTIONARY_FRAME, EMPTY_FRAME = 0x184D2A5D, "P*M\x18\x00\x00\x00\x00"

#: Payloads of fewer bytes are always stored.
LEAST = 100
ARCHIVE_BYTES, DICTIONARY_BYTES = 32 << 20, 64 << 10
#: A dictionary is trained on so many times its size, in pieces of so many bytes.
TRAINED, PIECE = 64, 1 << 13

RECORDS = "archive string, record_id string, record_type string, page_id string, url string, date string, payload_digest string, payload_bytes bigint, refers_to_record string, payload binary"


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16], version=4)}>"


def one_line(value: str) -> str:
    """A header's value: blanks and control characters as %XX, so that none ends the line."""
    return "".join(c if "\x20" < c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, block: bytes, date: str, **fields: str | None) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", date), *((k.replace("_", "-"), v) for k, v in fields.items() if v is not None), ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *(f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in head), b"", block]) + b"\r\n\r\n"


def page_record(page_id: str | None, url: str | None, payload: bytes, digest: str, first: str | None, date: str) -> bytes:
    """A response, or the revisit of what page `first` holds: then the block ends with the HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"WARC_Record_ID": record_id(page_id, digest), "WARC_Target_URI": url and one_line(url), "WARC_Payload_Digest": f"sha256:{digest}", "Content_Type": "application/http; msgtype=response", "Page_ID": page_id and quote(page_id, safe="")}
    if first is None:
        return record("response", http + payload, date, **fields)
    return record("revisit", http, date, **fields, WARC_Profile=REVISIT, WARC_Refers_To=record_id(first, digest))


def dictionary_of(records: list[bytes], most: int) -> bytes:
    """Trained on pieces that are spread evenly over all records; empty if they are too few to train on."""
    total = sum(map(len, records))
    step = max(1, total // (TRAINED * most))
    pieces = [r[a : a + PIECE] for r in records for a in range(0, len(r), PIECE)][::step]
    try:
        return zstandard.train_dictionary(min(most, total // 8), pieces, k=64, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def archive(records: list[bytes], dictionary_bytes: int, level: int) -> bytes:
    """The frames of one file."""
    trained = dictionary_of(records, dictionary_bytes)
    with_dictionary = {}
    if trained:
        with_dictionary["dict_data"] = zstandard.ZstdCompressionDict(trained)
        with_dictionary["dict_data"].precompute_compress(level=level)
    z = zstandard.ZstdCompressor(level=level, write_checksum=True, **with_dictionary)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(trained)), trained, *map(z.compress, records)])


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each from its own frame."""
    view, at, z = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_FRAME and size:
            z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(view[at + 8 : at + 8 + size]))
        if magic >> 4 == DICTIONARY_FRAME >> 4:
            at += 8 + size
            continue
        one, out = z.decompressobj(), []
        while not one.eof:
            part = view[at : at + (1 << 14)]
            if not part:
                raise ValueError("an archive ends within a frame")
            out.append(one.decompress(part))
            at += len(part)
        at -= len(one.unused_data)
        yield b"".join(out)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    fields = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if first != VERSION or rest[len(block) :] != b"\r\n\r\n" or len(block) != int(fields["Content-Length"]):
        raise ValueError(f"no WARC record: {data[:80]!r}")
    return fields, block


def stored_first(rows: DataFrame, least: int) -> DataFrame:
    """digest, first: of payloads that several pages have, the smallest page_id. One row a digest, whatever the number of its pages."""
    of = rows.where(F.octet_length("payload") >= least).groupBy(F.sha2("payload", 256).alias("digest"))
    return of.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")


def write_archives(pages: DataFrame, folder: str, work: Scratch, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES, level: int = 3, date: str | None = None) -> None:
    """Write a record for each row of pages (page_id, url, html) into archives in `folder`.

    Of rows with equal payloads of at least `least` bytes those with the smallest page_id are responses and the others revisit them; a null
    page_id counts as the largest. Rows that repeat page_id and payload are alike: each has its record. A null html is an empty payload; a null
    url or page_id has no header. An empty table gives no archive. Other columns are ignored. date: of all records, by default the present time.
    """
    prepare(pages.sparkSession)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id"), F.col("url").cast("string").alias("url"), as_text("html").cast("binary").alias("payload"))
    first = small(work.save(stored_first(rows, least), "first"), 100)
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    joined = rows.withColumn("digest", F.sha2("payload", 256)).join(first, "digest", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        info = record("warcinfo", b"format: WARC File Format 1.1\r\n", date, Content_Type="application/warc-fields")
        for batch in slices(batches, "payload"):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                records.append(page_record(*row, date))
                size += len(records[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive([info, *records], dictionary_bytes, level)], pa.binary())], names=["value"])
                    records, size = [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([archive([info, *records], dictionary_bytes, level)], pa.binary())], names=["value"])

    archives = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", other.alias("first")).mapInArrow(pack, "value binary")
    archives.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME).option("compression", "none").text(folder)


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The pages' records in the archives, each payload held against its digest; those of revisits are null, as all are without `payloads`."""
    prepare(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        kinds = [{"bigint": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in RECORDS.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for data in frames(content.as_py()):
                    fields, block = parsed(data)
                    if fields["WARC-Type"] not in ("response", "revisit"):
                        continue
                    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: {fields['WARC-Record-ID']} differs from its digest")
                    head = [fields.get(k) for k in ("WARC-Record-ID", "WARC-Type", "Page-ID", "WARC-Target-URI", "WARC-Date")]
                    head[2] = head[2] and unquote(head[2])
                    rows.append([path, *head, digest, None if payload is None else len(payload), fields.get("WARC-Refers-To"), payload if payloads else None])
                    size += len(payload or b"") if payloads else 0
                    if size > 8 << 20 or len(rows) >= 10_000:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(unpack, RECORDS)


def resolved(records: DataFrame, work: Scratch) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record: a revisit has its bytes, and its page, from the response it names."""
    here = work.save(records.drop("archive", "url", "date", "payload"), "records")
    named = here.where("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id")).distinct()
    stored = here.where("record_type = 'response'").join(named, "record_id", "left_semi").groupBy(F.col("record_id").alias("refers_to_record")).agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("bytes"))
    revisits = here.where("record_type = 'revisit'").join(small(work.save(stored, "stored"), 120), "refers_to_record", "left")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return here.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("string")).select(*columns).unionByName(revisits.withColumn("payload_bytes", F.col("bytes")).select(*columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: archives of all pages, read back."""
    work = Scratch(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    write_archives(pages, folder := f"{work.root}/archives", work)
    kind = pages.schema["page_id"].dataType
    found = resolved(read_archives(spark, folder, payloads=False), work)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
