from __future__ import annotations

import glob
import hashlib
import struct

import duckdb
import pytest
import zstandard
from llm.helpers import ODD, prose

from loomshed.llm.common import Scratch
from loomshed.llm.queries import ORACLES
from loomshed.llm.warc import archive, frames, one_line, page_record, parsed, query, read_archives, resolved, write_archives

PAGES = "page_id bigint, url string, html string, digest string, `first` int"


def pages(spark, texts):
    """Rows (page_id, html) or texts alone; two columns clash with names inside."""
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, f"http://x/{i}?a=b\r\nX: y", t, "clash", 1) for i, t in rows], PAGES)


def expected(rows):
    """Brute force: {(page_id, bytes, digest, type, refers_to): number of rows}."""
    found, firsts = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        if len(b) >= 100 and i is not None:
            firsts[b] = min(i, firsts.get(b, i))
    for i, t in rows:
        b = (t or "").encode()
        first = firsts.get(b)
        again = first is not None and i != first
        key = (i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None)
        found[key] = found.get(key, 0) + 1
    return found


def written(df, **more):
    work = Scratch(df.sparkSession, "test")
    write_archives(df, folder := f"{work.root}/archives", work, **more)
    return work, folder


def rows_of(df):
    found = {}
    for r in df.collect():
        key = (r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to))
        key = tuple(0 if k in (0, 4) and x == "0" else x for k, x in enumerate(key))
        found[key] = found.get(key, 0) + 1
    return {(int(k[0]) if k[0] is not None else None, *k[1:4], int(k[4]) if k[4] is not None else None): n for k, n in found.items()}


TEXTS = [*ODD, "x" * 99, "x" * 99, "x" * 100, "x" * 100, "é" * 50, "é" * 50, prose(1, 400), prose(1, 400), prose(2, 40000), prose(2, 40000), *([prose(3, 60)] * 40), (None, prose(1, 400)), (None, prose(4, 50)), (None, prose(4, 50)), (3, prose(3, 60)), (7, prose(5, 90)), (7, prose(5, 90)), (8, prose(5, 90))]


@pytest.mark.parametrize("archive_bytes", [1, 5000, 32 << 20])
def test_round_trip(spark, archive_bytes):
    """Every payload, byte for byte, and the same rows as by brute force, whatever the size of an archive."""
    df = pages(spark, TEXTS)
    work, folder = written(df, archive_bytes=archive_bytes)
    records = read_archives(spark, folder)
    assert rows_of(resolved(records, work)) == expected([(r.page_id, r.html) for r in df.collect()])
    stored = {r.payload_digest: bytes(r.payload) for r in records.where("record_type = 'response'").collect()}
    assert {b for b in stored.values()} == {(r.html or "").encode() for r in df.collect()}
    assert {r.url for r in records.collect()} >= {"http://x/0?a=b%0D%0AX:%20y"}


def test_frames_as_any_reader_sees_them(spark):
    """A leading skippable frame holds the dictionary; each record is a frame of its own, read with the dictionary and not without."""
    _, folder = written(pages(spark, [prose(k, 300) for k in range(300)]).coalesce(1))
    (path,) = glob.glob(f"{folder.removeprefix('file:')}/part*")
    data = open(path, "rb").read()
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D and 0 < size <= 64 << 10
    trained = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    assert trained.dict_id() == zstandard.get_frame_parameters(data[8 + size :]).dict_id != 0
    one = zstandard.ZstdDecompressor(dict_data=trained).decompressobj()
    assert one.decompress(data[8 + size :]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and one.eof
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + size :])
    assert len(list(frames(data))) == 301
    alone = sum(len(zstandard.compress(x, 3)) for x in frames(data))
    assert len(data) < 0.9 * alone
    assert zstandard.ZstdDecompressor(dict_data=trained).stream_reader(data, read_across_frames=True).read().count(b"WARC/1.1\r\n") == 301


def test_too_few_records_for_a_dictionary():
    data = archive([b"abc", b""], 1 << 16, 3)
    assert struct.unpack_from("<II", data) == (0x184D2A5D, 0) and list(frames(data)) == [b"abc", b""]


def test_damage_shows():
    records = [page_record(str(k), None, prose(k, 100).encode(), "0" * 64, None, "d") for k in range(100)]
    data = bytearray(archive(records, 1 << 14, 3))
    assert list(frames(bytes(data))) == records
    with pytest.raises(ValueError, match="within a frame"):
        list(frames(bytes(data[:-5])))
    data[-20] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(frames(bytes(data)))
    with pytest.raises(ValueError, match="no WARC record"):
        parsed(records[0][:-1])


def test_headers_hold_one_line():
    assert one_line("a b\r\nc\x7fé") == "a%20b%0D%0Ac%7Fé"
    fields, block = parsed(page_record("5", "http://é/\n", b"\r\n\r\nx", "ab", "3", "d"))
    assert fields["WARC-Target-URI"] == "http://é/%0A" and fields["WARC-Type"] == "revisit" and block.endswith(b"\r\n\r\n") and "Content-Length: 5" in block.decode()


def test_ids_of_any_text(spark):
    """An identifier may hold what would end a header's line."""
    ids = ["a\r\nWARC-Type: x", "é %0A", "-5", "", None]
    df = spark.createDataFrame([(i, None, prose(k, 40)) for k, i in enumerate(ids)], "page_id string, url string, html string")
    _, folder = written(df)
    got = read_archives(spark, folder).collect()
    assert sorted(r.page_id or "" for r in got) == sorted(i or "" for i in ids) and {r.url for r in got} == {None} and {r.record_type for r in got} == {"response"}


def test_empty_table(spark):
    work, folder = written(pages(spark, ["x"]).limit(0))
    assert resolved(read_archives(spark, folder), work).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet')")
    got = {tuple(r) for r in query(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    want = con.execute(f"SELECT page_id, payload_bytes, payload_digest, record_type, refers_to FROM ({ORACLES['op11_warc']})").fetchall()
    assert got == set(want) and len(want) == 250
