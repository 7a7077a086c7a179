"""Near-duplicate vectors by spherical-cap filters.

The filters are a random product code: the vector is cut into blocks, each block has a codebook of random unit
vectors, and a filter is a choice of one code word per block. A filter's score is the sum of its blocks' inner
products, so the list of all filters above a threshold is decoded from two sorted halves without visiting the
others. There are several independent codes, as one alone loses a link in some thousands. Equal vectors are one, with a count.
Vectors that share a filter (and label) are compared in double precision, block by block; a pair counts in the
first filter that it shares, so each link counts once though it may meet often.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import connected_components

BLOCK = 1024
#: Buckets of so many rows at most are looked through together with others of their size.
SMALL = 48


@dataclass(frozen=True)
class Caps:
    """words: code words per block (filters: words ** 4); mean: filters of a code that a vector exceeds on average; least: a vector
    with fewer lowers its own threshold until it has so many; codes: how many independent codes there are."""

    words: int = 32
    mean: float = 24
    least: int = 20
    seed: int = 11
    codes: int = 2

    def codebooks(self, dim: int, code: int = 0) -> np.ndarray:
        """4 x words x block size; blocks are padded with zeros."""
        rng = np.random.default_rng([self.seed + code, dim, self.words])
        size = -(-dim // 4)
        books = rng.standard_normal((4, self.words, size))
        books /= np.linalg.norm(books, axis=2, keepdims=True)
        return books

    def threshold(self, dim: int) -> float:
        return NormalDist().inv_cdf(1 - min(0.5, self.mean / self.words**4)) / sqrt(-(-dim // 4))

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit row of x the ids of its filters of all codes, sorted."""
        return [np.concatenate([y + k * self.words**4 for k, y in enumerate(of_row)]) for of_row in zip(*(self.decode(x, k) for k in range(self.codes)), strict=True)]

    def decode(self, x: np.ndarray, code: int = 0) -> list[np.ndarray]:
        """For each unit row of x the ids of all filters of a code whose score exceeds its threshold, sorted."""
        n, dim = x.shape
        books, w = self.codebooks(dim, code), self.words
        size = books.shape[2]
        padded = np.zeros((n, 4 * size))
        padded[:, :dim] = x
        scores = np.einsum("nbs,bws->nbw", padded.reshape(n, 4, size), books)
        left = (scores[:, 0, :, None] + scores[:, 1, None, :]).reshape(n, w * w)
        right = (scores[:, 2, :, None] + scores[:, 3, None, :]).reshape(n, w * w)
        out, start = [], self.threshold(dim)
        for a, b in zip(left, right, strict=True):
            by_b = np.argsort(-b)
            sorted_b, t = -b[by_b], start
            top = b[by_b[0]]
            while True:
                rows = np.flatnonzero(a >= t - top)
                counts = np.searchsorted(sorted_b, a[rows] - t, side="right")
                if counts.sum() >= min(self.least, w**4):
                    break
                t -= 0.02
            out.append(np.sort(np.concatenate([r * w * w + by_b[:c] for r, c in zip(rows, counts, strict=True)])).astype(np.int64))
        return out


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists are of one length, as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; by their largest component first, as squares may leave the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_links(least: float, f: int, rows: np.ndarray, part: np.ndarray, z: np.ndarray, lists: list[np.ndarray], low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the unit rows of parts `low` and `high` of filter f's bucket that share no filter before f."""
    i, j = np.flatnonzero(part == low), np.flatnonzero(part == high)
    near = z[i] @ z[j].T >= least
    near &= rows[i][:, None] < rows[j][None, :] if low == high else True
    a, b = np.nonzero(near)
    if not a.size:
        return a, b
    used = np.unique(np.concatenate([i[a], j[b]]))
    before = [lists[k][lists[k] < f] for k in used]
    names, at = np.unique(np.concatenate(before), return_inverse=True)
    has = np.zeros((len(z), max(1, len(names))), np.float32)
    has[np.repeat(used, [len(y) for y in before]), at] = 1
    ok = (has[i] @ has[j].T)[a, b] == 0
    return i[a[ok]], j[b[ok]]


def shard_links(rows_of: pa.Table, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in rows_of of the links of all its buckets; of small buckets those of one size are looked through together for any link."""
    frame = pd.DataFrame({c: rows_of.column(c).to_pandas() for c in ("row", "label", "dim", "filter", "part", "low", "high")})
    x, lists = rows_of.column("x").combine_chunks(), rows_of.column("filters").combine_chunks()
    bucket = frame.groupby(["label", "dim", "filter", "low", "high"], sort=False).ngroup().to_numpy()
    order = np.argsort(bucket, kind="stable")
    size = np.bincount(bucket)
    start = np.cumsum(size) - size
    row, filters, part, low, high, dim = (frame[c].to_numpy() for c in ("row", "filter", "part", "low", "high", "dim"))
    cuts, ids = lists.offsets.to_numpy(), lists.values.to_numpy()
    z: dict[int, np.ndarray] = {}
    place = np.zeros(len(row), np.int64)
    for d in np.unique(dim):
        own = np.flatnonzero(dim == d)
        place[own], z[d] = np.arange(own.size), unit(matrix(x.take(pa.array(own))))
    a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    of_bucket = dim[order[start]] if size.size else dim
    for d in np.unique(dim):
        linked = [np.flatnonzero((of_bucket == d) & (size > SMALL))]
        for s in range(2, SMALL + 1):
            chosen = np.flatnonzero((of_bucket == d) & (size == s))
            step = max(1, (1 << 20) // (s * max(s, int(d))))
            for k in range(0, chosen.size, step):
                at = order[start[chosen[k : k + step]][:, None] + np.arange(s)]
                v = z[d][place[at]]
                near = np.count_nonzero(v @ v.transpose(0, 2, 1) >= least - 1e-9, axis=(1, 2))
                linked.append(chosen[k : k + step][near > s])  # each row is near itself
        for k in np.concatenate(linked):
            at = order[start[k] : start[k] + size[k]]
            i, j = bucket_links(least, filters[at[0]], row[at], part[at], z[d][place[at]], [ids[cuts[y] : cuts[y + 1]] for y in at], low[at[0]], high[at[0]])
            a_out.append(at[i])
            b_out.append(at[j])
    return np.concatenate(a_out), np.concatenate(b_out)


def near_vectors(vectors: DataFrame, least: float = 0.98, caps: Caps | None = None, key: str = "vec_id", vector: str = "embedding", label: str = "label", work: Scratch | None = None) -> DataFrame:
    """key, n_links, component_id, kept of every row.

    Rows are linked if their labels are equal and not null, their lengths are equal, and their cosine is at least
    `least`. Vectors that are null, empty, zero or hold null or non-finite components link with nothing. Repeated
    rows are vectors of their own. component_id is the smallest key of a component (null if it has none).
    Without caps, the code's size follows the number of vectors: chance meetings stay below one per vector and filter.
    Vectors of doubles stay doubles. Extra columns are ignored.
    """
    work = work or Scratch(vectors.sparkSession, "vectors")
    before = len(work.tables)
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    everything = work.save(vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast(kind).alias("x")).withColumn("row", F.monotonically_increasing_id()), "everything")
    sound = F.col("label").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    # equal vectors of a label are one: told by 128 bits of hash
    same = ["label", "dim", "h1", "h2"]
    all_rows = work.save(everything.select("row", "key", F.when(sound, F.col("label")).alias("label"), F.size("x").alias("dim"), F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(7), "x").alias("h2")), "rows")
    classes = work.save(all_rows.where("label is not null").groupBy(*same).agg(F.min("row").alias("row"), F.count("*").alias("copies"), F.min("key").alias("least")), "classes")
    if caps is None:
        n, words = classes.count(), 16
        while words**4 < 16 * n:
            words *= 2
        caps = Caps(words=words)
    few = max(1, min(256, (1 << 24) // caps.words**2))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                own = batch.filter(pa.array(dims == d))
                for at in range(0, own.num_rows, few):
                    part = own.slice(at, few)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(caps.lists(unit(matrix(part.column("x")))), pa.list_(pa.int64()))], names=[*part.schema.names, "filters"])

    usable = classes.select("row", "label", "dim", "copies").join(everything.select("row", "x"), "row")
    usable = work.save(usable.mapInArrow(listed, f"row bigint, label string, dim int, copies bigint, x {kind}, filters array<bigint>"), "listed")
    filters = usable.select("row", "label", "dim", F.explode("filters").alias("filter"))
    shared = filters.groupBy("label", "dim", "filter").agg(F.count("*").alias("n")).where("n > 1")
    # a bucket is cut into parts of about BLOCK rows; each pair of parts is one unit of work, in a shard with others
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    met = filters.join(shared, ["label", "dim", "filter"]).withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    units = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("row", "label", "dim", "filter", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    units = work.save(units, "units")
    shards = max(1, units.count() // 8192)
    placed = units.withColumn("shard", F.pmod(F.xxhash64("label", "dim", "filter", "low", "high"), F.lit(shards))).join(usable.select("row", "copies", "x", "filters"), "row")

    def compare(rows_of: pa.Table) -> pa.Table:
        a, b = shard_links(rows_of, least)
        rows, copies = rows_of.column("row").to_numpy(), rows_of.column("copies").to_numpy()
        return summary(rows[a], rows[b], copies[a], copies[b])

    found = work.save(placed.groupBy("shard").applyInArrow(compare, "row bigint, n bigint, root bigint"), "found")
    counts = found.groupBy("row").agg(F.sum("n").alias("others"))
    groups = connected_components(found.select(F.col("row").alias("a"), F.col("root").alias("b")), work)
    of_class = classes.join(counts, "row", "left").join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    smallest = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = work.save(of_class.join(smallest, "component").select(*same, (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).cast("bigint").alias("n_links"), "component_id"), "of_class")
    work.keep(before, "rows", "of_class")
    # a class may have many copies: its row is sent if there are few classes, else the join is split
    result = all_rows.join(of_class, same, "left").select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.coalesce("n_links", F.lit(0)) == 0, F.col("key")).otherwise(F.col("component_id")).cast("bigint").alias("component_id"))
    return result.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def summary(a: np.ndarray, b: np.ndarray, copies_a: np.ndarray | None = None, copies_b: np.ndarray | None = None) -> pa.Table:
    """Links as one line per row: to how many vectors, and the smallest row that these links lead to."""
    rows, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: a.size], at[a.size :]
    root = np.arange(rows.size)
    while True:
        new = root.copy()
        np.minimum.at(new, u, root[v])
        np.minimum.at(new, v, root[u])
        new = new[new]
        if (new == root).all():
            break
        root = new
    weights = None if copies_a is None else np.concatenate([copies_b, copies_a]).astype(float)
    return pa.table({"row": rows.astype(np.int64), "n": np.bincount(at, weights, minlength=rows.size).astype(np.int64), "root": rows[root].astype(np.int64)})


def query(spark, sf_dir: str) -> DataFrame:
    """op3: links and components of all vectors."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
