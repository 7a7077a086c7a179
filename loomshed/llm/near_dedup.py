"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact confirmation.

Documents with equal shingle sets are one class, so copies cost nothing further. A class's sketch comes from one
permutation: its hashes fall into bins, each bin keeps its least, and an empty bin borrows from a bin that its own
random probe sequence finds first (optimal densification). Bands of the sketch are bucket keys. In a bucket, pairs are
not formed; every member is compared with the bucket's centre, the member with the fewest shingles of its own.
What a shingle that no other candidate has can't do is overlap: that bounds a pair's overlap from above, exactly, and
spares most comparisons. Confirmed stars give components; where a bucket still holds several, its members outside
the largest one are compared with the rest. So no link between members of a bucket that matters to a component
is lost, and the comparisons of a group of copies grow with its size, not with the square.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, as_text, slices
from .components import connected_components

_ODD = np.random.default_rng(5).integers(1 << 62, (1 << 63) - 1, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit matters to every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """word -> 64-bit hash, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `size` words; of its whole sequence if it has fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        h = np.full(len(words) - n + 1, n, np.uint64)
        for k in range(n):
            h += w[k : len(words) - n + 1 + k] * _ODD[k]
    return np.unique(mixed(h))


@dataclass(frozen=True)
class Sketch:
    """2 ** bits bins, rows of them to a band. At similarity 0.85 a pair shares no band with probability 6e-11, at 0.8 with 5e-8."""

    bits: int = 7
    rows: int = 4
    seed: int = 3

    def probes(self) -> np.ndarray:
        bins = 1 << self.bits
        return np.random.default_rng(self.seed).integers(0, bins, (bins, 64))

    def bands(self, hashes: np.ndarray, probes: np.ndarray) -> np.ndarray:
        """Band keys of a non-empty sorted set of hashes."""
        bins = 1 << self.bits
        of = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        first = np.flatnonzero(np.diff(of, prepend=-1))
        filled = np.zeros(bins, bool)
        filled[of[first]] = True
        value = np.zeros(bins, np.uint64)
        with np.errstate(over="ignore"):
            value[of[first]] = hashes[first] << np.uint64(self.bits)
        empty = np.flatnonzero(~filled)
        if empty.size:
            hit = filled[probes[empty]]
            found = hit.any(axis=1)
            source = probes[empty, hit.argmax(axis=1)]
            if not found.all():  # 64 probes missed: the first filled bin from a random place on
                at = np.flatnonzero(filled)
                source[~found] = at[probes[empty[~found], 0] % at.size]
            value[empty] = value[source]
        with np.errstate(over="ignore"):
            parts = value.reshape(-1, self.rows) * _ODD[8 : 8 + self.rows]
            return mixed(parts.sum(axis=1, dtype=np.uint64) + np.arange(len(parts), dtype=np.uint64) * _ODD[40]).view(np.int64)


def may_link(na: Column, nb: Column, shared_a: Column, shared_b: Column, percent: int) -> Column:
    """Whether an overlap of at most both counts of shared shingles can reach the similarity."""
    return (100 + percent) * F.least(shared_a, shared_b) >= percent * (na + nb)


def near_duplicates(rows: DataFrame, size: int = 5, percent: int = 80, sketch: Sketch | None = None, work: Scratch | None = None) -> DataFrame:
    """__row, doc_id, n_shingles, component_id, kept, first of every row of `rows` (__row, doc_id, text, stored).

    Documents are linked if 100 * intersection >= percent * union of their sets of shingles of `size` lower-cased (A-Z)
    words. A text with fewer words is one shingle; one without words (or null) is empty and linked with nothing.
    component_id: the smallest doc_id of the component, nulls last; kept: doc_id = component_id; first: true for one
    row of each component, also among rows of one doc_id. Empty tables give no row.
    """
    work, sketch = work or Scratch(rows.sparkSession, "near"), sketch or Sketch()
    before = len(work.tables)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, probes = WordHashes(), sketch.probes()
        for batch in slices(batches):
            n, digest, bands = [], [], []
            for t in batch.column("text").to_pylist():
                h = shingles(t, size, known)
                n.append(h.size)
                digest.append(xxhash.xxh3_128_digest(h.tobytes()) if h.size else None)
                bands.append(sketch.bands(h, probes) if h.size else None)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["__row", "doc_id", "n_shingles", "digest", "bands"])

    texts = rows.select("__row", "doc_id", as_text("text").alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    sets = work.save(texts.mapInArrow(sketched, f"__row bigint, doc_id {id_kind}, n_shingles bigint, digest binary, bands array<bigint>"), "sets")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    classes = work.save(sets.where("n_shingles > 0").groupBy("digest").agg(F.min(place).alias("least"), F.min(F.struct("__row", "n_shingles", "bands")).alias("x")).select("digest", "least", F.col("x.__row").alias("row"), F.col("x.n_shingles").alias("n"), F.col("x.bands").alias("bands")), "classes")
    # counted by aggregates, not by a window: a hot bucket's rows are added up where they are, and its join is split
    keyed = classes.select("row", "n", F.explode("bands").alias("key"))
    shared_keys = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key")
    members = work.save(keyed.join(shared_keys, "key"), "members")

    # each candidate's shingles are made once more and written down: nothing after this reads a text
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches, most=2 << 20):
            found = [shingles(t, size, known).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(found, pa.list_(pa.int64()))], names=["row", "h"])

    candidates = work.save(members.select("row", "n").distinct(), "candidates")
    chosen = texts.join(candidates, texts["__row"] == candidates["row"]).select("__row", "text")
    hashes = work.save(chosen.mapInArrow(spread, "row bigint, h array<bigint>"), "hashes")
    # of each candidate, how many of its shingles no other candidate has
    alone = hashes.select("row", F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("row").alias("row")).where("c = 1").groupBy("row").agg(F.count("*").alias("own"))
    known = candidates.join(alone, "row", "left").select("row", "n", F.coalesce("own", F.lit(0)).alias("own")).where(100 * (F.col("n") - F.col("own")) >= percent * F.col("n"))
    alive = work.save(members.drop("n").join(work.save(known, "known"), "row"), "alive")
    centres = work.save(alive.groupBy("key").agg(F.min(F.struct("own", "row", "n")).alias("centre"), F.count("*").alias("many")).where("many > 1"), "centres")
    buckets = work.save(alive.join(centres, "key"), "buckets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """a, b, whether their full sets are similar enough, and how many shingles both have. Each b brings its set along to where that of its a is: a centre's is one row, however many members it has."""
        side = lambda k: hashes.select(F.col("row").alias(k), F.col("h").alias(f"h_{k}"))
        met = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", F.size(F.array_intersect("h_a", "h_b")).cast("bigint").alias("both"), (F.size("h_a") + F.size("h_b")).alias("sizes"))
        return work.save(met.select("a", "b", (100 * F.col("both") >= percent * (F.col("sizes") - F.col("both"))).alias("ok"), "both"), name)

    c = F.col("centre")
    stars = buckets.where((c["row"] != F.col("row")) & may_link(c["n"], F.col("n"), c["n"] - c["own"], F.col("n") - F.col("own"), percent)).select(c["row"].alias("a"), F.col("row").alias("b")).distinct()
    stars = confirmed(work.save(stars, "stars"), "star_links")
    links = stars.where("ok").select("a", "b")
    groups = connected_components(links, work, "first")

    # where a bucket holds several components: members outside its largest one against the others
    # a bucket of two has no other pair than that with its centre
    marked = buckets.where("many > 2").join(groups.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    parts = work.save(marked.groupBy("key", "component").agg(F.count("*").alias("same")), "parts")
    several = parts.groupBy("key").agg(F.count("*").alias("components"), F.max(F.struct("same", "component")).alias("largest")).where("components > 1")
    marked = marked.join(work.save(several.select("key", F.col("largest.component").alias("largest")), "several"), "key")
    # What two members share is in the centre or outside it. Inside they share no more than either shares with the
    # centre; outside no more than either has there, without what it has alone (which the centre can't have).
    overlap = stars.select("a", "b", "both")
    marked = marked.withColumn("a", c["row"]).withColumn("b", F.col("row")).join(overlap, ["a", "b"], "left")
    shared = F.col("n") - F.col("own")
    inside = F.when(F.col("row") == c["row"], F.col("n")).otherwise(F.coalesce("both", shared))
    outside = F.when(F.col("row") == c["row"], F.lit(0)).otherwise(shared - F.coalesce("both", F.lit(0)))
    # by centre and largest component a pair meets once, however many buckets both are in
    marked = work.save(marked.select(c["row"].alias("centre"), "largest", "component", "row", "n", inside.alias("inside"), outside.alias("outside"), shared.alias("shared")).distinct(), "marked")
    x, y = marked.where("component != largest").alias("x"), marked.alias("y")
    overlap = F.least("x.shared", "y.shared", F.least("x.inside", "y.inside") + F.least("x.outside", "y.outside"))
    possible = (100 + percent) * overlap >= percent * (F.col("x.n") + F.col("y.n"))
    open_pairs = (F.col("x.centre") == F.col("y.centre")) & (F.col("x.largest") == F.col("y.largest")) & (F.col("x.component") != F.col("y.component")) & ((F.col("y.component") == F.col("y.largest")) | (F.col("x.row") < F.col("y.row"))) & possible
    rest = x.join(y, open_pairs).select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct().join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    rest = confirmed(work.save(rest, "rest"), "rest_links")
    final = connected_components(links.union(rest.where("ok").select("a", "b")), work, "final")

    grouped = classes.select("digest", "row", "least").join(final.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    heads = work.save(grouped.groupBy("component").agg(F.min("least").alias("head")), "least")
    heads = work.save(grouped.join(heads, "component").select("digest", "head"), "heads")
    work.keep(before, "sets", "heads")
    result = sets.select("__row", "doc_id", "n_shingles", "digest").join(heads, "digest", "left")
    head = F.coalesce("head", place)
    return result.select("__row", "doc_id", "n_shingles", head["doc_id"].alias("component_id"), F.col("doc_id").eqNullSafe(head["doc_id"]).alias("kept"), (F.col("__row") == head["__row"]).alias("first"))


def stored(docs: DataFrame, work: Scratch) -> DataFrame:
    """docs with a running number __row that stays, as it is written down."""
    return work.save(docs.withColumn("__row", F.monotonically_increasing_id()), "docs")


def query(spark, sf_dir: str) -> DataFrame:
    """op10: components of all documents, three-word shingles at 0.85."""
    work = Scratch(spark, "near")
    docs = stored(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), work)
    return near_duplicates(docs, size=3, percent=85, work=work).select("doc_id", "n_shingles", "component_id", "kept")
