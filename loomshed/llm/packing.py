"""Best-fit packing of token sequences, with the large pieces matched in pairs first.

A piece's length is a small integer, so a packing is planned on how many pieces have each length: the
driver sees at most `capacity` counts, however many documents there are. Pieces above a third of the capacity fit
at most twice into a sequence; they are matched greedily, the longest with the longest that still fits. Shorter
ones then go, longest first, to the smallest gap that takes them, in bulk: all sequences that look alike are one
group. The pieces of each length are numbered across all tasks, and a number leads to its group, sequence and offset.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_text, slices, small
from .tokens import tokenizer_path, tokens

CAPACITY = 2048


@dataclass
class Plan:
    """Slots sorted by (length, first): pieces first .. first + runs * each - 1 of that length."""

    length: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.int64(1) << 46
        k = np.searchsorted(self.length * wide + self.first, length * wide + number, side="right") - 1
        past = number - self.first[k]
        return self.sequence[k] + past // self.each[k], self.offset[k] + past % self.each[k] * length


def match_large(left: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Groups of one or two large pieces; the counts in `left` go to zero."""
    sizes, groups = sorted(left), []
    for s in reversed(sizes):
        while left[s]:
            k = bisect_left(sizes, min(s, capacity - s) + 1) - 1
            while k >= 0 and not left[sizes[k]] - (sizes[k] == s and left[s] < 2):
                k -= 1
            t = sizes[k] if k >= 0 else None
            n = left[s] if t is None else left[s] // 2 if t == s else min(left[s], left[t])
            groups.append(([(s, 1)] if t is None else [(s, 2)] if t == s else [(s, 1), (t, 1)], n))
            left[s] -= n
            if t is not None:
                left[t] -= n
        sizes.pop()
    return groups


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """counts: number of pieces by length (1 to capacity)."""
    groups = match_large({s: n for s, n in counts.items() if 3 * s > capacity and n}, capacity)
    gaps: dict[int, list] = {}
    open_gaps: list[int] = []

    def put(items: list[tuple[int, int]], n: int) -> None:
        gap = capacity - sum(s * k for s, k in items)
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append((items, n))

    for items, n in groups:
        put(items, n)
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        left = counts[s]
        while left:
            k = bisect_left(open_gaps, s)
            if k == len(open_gaps):
                each = capacity // s
                if left >= each:
                    put([(s, each)], left // each)
                if left % each:
                    put([(s, left % each)], 1)
                break
            gap = open_gaps[k]
            items, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[k]
            each = gap // s
            if left < each:
                used, take = 1, left
            else:
                used, take = min(n, left // each), each
            if used < n:
                put(items, n - used)
            put([*items, (s, take)], used)
            left -= used * take
    slots, sequence, numbered = [], 0, Counter()
    for items, n in (g for gap in sorted(gaps) for g in gaps[gap]):
        offset = 0
        for s, each in items:
            slots.append((s, numbered[s], each, sequence, offset))
            numbered[s] += n * each
            offset += s * each
        sequence += n
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    return Plan(*table.T, sequences=sequence)


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, stop) of the pieces; only the first may be shorter than the capacity."""
    first = length % capacity
    return ([(0, first)] if first else []) + [(k, k + capacity) for k in range(first, length, capacity)]


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = CAPACITY,
    end_id: int = 0,
    derive: Callable[[np.ndarray], object] | None = None,
    derived: tuple[str, str] = ("tokens", "array<int>"),
    text: str = "text",
    work: Scratch | None = None,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, the piece's token ids, sequence_id, offset.

    derive: turns a piece's ids into the column `derived` instead, where the ids themselves aren't wanted.
    Null texts count as empty: one piece of the end id. Repeated rows are packed each. Extra columns are ignored.
    An empty table gives no row.
    """
    work = work or Scratch(docs.sparkSession, "packing")
    name, kind = derived
    made = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]
    id_kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(tokenizer if os.sep in tokenizer else tokenizer_path(tokenizer))
        task, seen = TaskContext.get().partitionId(), Counter()
        for batch in slices(batches, "__text", 2 << 20):
            rows: list[tuple] = []
            for k, x in enumerate(batch.column("__text").to_pylist()):
                ids = np.array([*t.ids(x), end_id], "<u4")
                for piece, (a, b) in enumerate(cut(len(ids), capacity)):
                    rows.append((k, piece, a, b - a, derive(ids[a:b]) if derive else ids[a:b].astype(np.int32), seen[b - a]))
                    seen[b - a] += 1
            if rows:
                k, piece, start, length, value, number = zip(*rows, strict=True)
                columns = [batch.column("doc_id").take(pa.array(k)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(value, made), pa.array([task] * len(k), pa.int32()), pa.array(number, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", name, "__task", "__number"])

    cut_up = docs.select("doc_id", as_text(text).alias("__text")).mapInArrow(run, f"doc_id {id_kind}, piece int, start bigint, length bigint, `{name}` {kind}, __task int, __number bigint")
    pieces = work.save(cut_up, "pieces")
    # each task numbered its own pieces of a length; the sums of the tasks before it make the numbers global
    per_task = work.save(pieces.groupBy("__task", "length").agg(F.count("*").alias("n")), "per_task")
    plan = plan_packing({r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("__task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    numbered = pieces.join(small(base, 24), ["__task", "length"]).select("doc_id", "piece", "start", "length", name, (F.col("__base") + F.col("__number")).alias("__number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("__number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return numbered.mapInArrow(place, f"doc_id {id_kind}, piece int, start bigint, length bigint, `{name}` {kind}, sequence_id bigint, offset bigint")


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def query(spark, sf_dir: str) -> DataFrame:
    """op5: all documents packed, with each piece's ids as a checksum."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), derive=ids_crc32, derived=("ids_crc32", "bigint"))
