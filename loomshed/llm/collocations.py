"""Phrases whose words stand together more often than their parts do alone, with exact counts.

The text is cut into shards, some million words of one language each, and every shard has a trie of its own whose nodes
are phrases with their counts, by level: of one word, of two, and so on to the deepest. A level is serialised sorted, in one block for each
prefix range: parents, each with its children. What all shards have of a range meets in one group, where the sorted runs are
merged. A phrase that all shards together hold often enough gets a number, and goes back to the shards that have it; only such nodes
get children: no phrase is more frequent than its parts, so nothing is missed, and what is shuffled doesn't grow with the rare phrases.
From the second level on, numbers alone are shuffled.

A node of d + 1 words is where two neighbouring nodes of d words overlap. The first is its parent, the other its suffix link. In the
merged trie the walk down from parent to child gives the counts of all left parts, the suffix links give those of all right parts.
Children of a parent that is a large part of all text are dealt out to as many ranges as its total calls for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, as_text, prepare, slices, small

#: Words of the shards that a task has at once, about.
SHARD_WORDS = 6 << 20
#: Prefix ranges for each part that the input is read in, so that a range's size doesn't grow with the input.
RANGES_A_PART = 4
#: Occurrences of a parent for each range that its children are dealt out to.
SPLIT = 1 << 20
#: A-Z in lower case; what ends a piece as a line's end, and the tab as a space.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10 + b" ")
GAP = -1

#: Rows of a level: a shard's text as the numbers of its nodes, or a block of its trie.
LEVEL = "is_text boolean, lang string, shard bigint, words bigint, state binary, range int, parents binary, block binary"
#: Rows of what is merged: a phrase with its total, or what goes back to a shard.
MERGED = "lang string, id bigint, phrase string, parent bigint, link bigint, a bigint, shard bigint, block binary"


class Words(dict):
    """word -> number, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self) - 1
        return k


def words_of(text: str) -> list[bytes]:
    """Words, with a line's end between pieces."""
    return [w for w in text.encode("utf-8", "surrogatepass").translate(FOLD).replace(b"\n", b" \n ").split(b" ") if w]


def packed(columns: dict[str, pa.Array]) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(block: bytes) -> pa.Table:
    return pa.ipc.open_stream(block).read_all()


def rows(kind: str, **columns: list) -> pa.RecordBatch:
    """Rows of LEVEL or MERGED; columns that aren't given are null."""
    types = {"boolean": pa.bool_(), "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields, size = [x.split(" ") for x in kind.split(", ")], len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(size, types[t]) for c, t in fields], names=[c for c, _ in fields])


def without_long_gaps(state: np.ndarray) -> np.ndarray:
    return state[(state >= 0) | (np.append(0, state[:-1]) >= 0)]


@dataclass
class Nodes:
    """A level of a shard's trie, sorted: of each node its parent (the first level has none), its suffix link or word, and its count."""

    parent: np.ndarray
    link: pa.Array
    n: np.ndarray

    def blocks(self, ranges: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
        """range, its parents with their numbers of children, and its nodes, each by its distance from the one before."""
        order = np.argsort(ranges, kind="stable")
        starts = np.flatnonzero(np.diff(ranges[order], prepend=-1))
        for k in np.split(order, starts[1:]) if order.size else []:
            firsts = np.flatnonzero(np.diff(self.parent[k], prepend=-1))
            above = {"parent": pa.array(self.parent[k[firsts]]), "children": pa.array(np.diff(np.append(firsts, k.size)), pa.int32())}
            yield int(ranges[k[0]]), packed(above), packed({"step": pa.array(np.diff(k, prepend=0), pa.int32()), "link": self.link.take(pa.array(k)), "n": pa.array(self.n[k])})


def level_rows(lang: str, shard: int, state: np.ndarray, words: int | None, nodes: Nodes, ranges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A shard's text, and its nodes in a block for each range."""
    yield rows(LEVEL, is_text=[True], lang=[lang], shard=[shard], words=[words], state=[zstandard.compress(without_long_gaps(state).astype(np.int32).tobytes(), 1)])
    blocks = list(nodes.blocks(ranges))
    yield rows(LEVEL, is_text=[False] * len(blocks), lang=[lang] * len(blocks), shard=[shard] * len(blocks), range=[b[0] for b in blocks], parents=[b[1] for b in blocks], block=[b[2] for b in blocks])


def read_block(parents: bytes, block: bytes) -> pa.Table:
    """node, parent, link, n of each node of a block."""
    above, nodes = unpacked(parents), unpacked(block)
    parent = np.repeat(above.column("parent").to_numpy(), above.column("children").to_numpy())
    return pa.table({"node": np.cumsum(nodes.column("step").to_numpy(), dtype=np.int64), "parent": parent, "link": nodes.column("link"), "n": nodes.column("n")})


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each number."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(8)


def first_level(docs: DataFrame, ranges: int, shard_words: int) -> DataFrame:
    """Shards of the texts, with words as nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size, shards = TaskContext.get().partitionId(), 0, 0, {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for k, (lang, (numbers, parts)) in enumerate(shards.items()):
                names = [w for w in numbers if w != b"\n"]
                order = sorted(range(len(names)), key=names.__getitem__)
                names, place = [names[i] for i in order], np.empty(len(names) + 1, np.int64)
                place[order], place[-1] = np.arange(len(names)), GAP
                state = place[np.concatenate(parts)]
                n = np.bincount(state[state >= 0], minlength=len(names))
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
                yield from level_rows(lang, (task << 32) + number + k, state, int(n.sum()), Nodes(np.zeros(len(names), np.int64), pa.array(names, pa.binary()), n.astype(np.int64)), (h % np.uint64(ranges)).astype(np.int64))

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                numbers, parts = shards.setdefault(lang, (Words({b"\n": GAP}), []))
                words = [b"\n", *words_of(text)]
                parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= shard_words:
                    yield from flushed()
                    number, size, shards = number + len(shards), 0, {}
        yield from flushed()

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), as_text("text").alias("text")).mapInArrow(run, LEVEL)


def merged(level: DataFrame, d: int, least: int, feeds: bool) -> DataFrame:
    """Phrases of d words that all shards together have `least` times, numbered in their range; and for each shard what it has of them."""

    def merge(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("shard")
        tables = [read_block(a.as_py(), b.as_py()) for a, b in zip(blocks.column("parents"), blocks.column("block"), strict=True)]
        table = pa.concat_tables(tables).combine_chunks()
        if d == 1:
            key = np.array([*table.column("link").to_pylist(), None], object)[:-1]
        else:
            parents, parent = np.unique(table.column("parent").to_numpy(), return_inverse=True)
            links, link = np.unique(table.column("link").to_numpy(), return_inverse=True)
            key = parent * links.size + link
        order = np.argsort(key, kind="stable")  # the blocks are sorted runs, which it merges
        ordered = key[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        totals = np.add.reduceat(table.column("n").to_numpy()[order], starts)
        found = np.flatnonzero(totals >= least)
        first = table.take(pa.array(order[starts[found]]))
        ids = (blocks.column("range")[0].as_py() << 32) + np.arange(found.size)
        named = {"phrase": [w.decode() for w in first.column("link").to_pylist()]} if d == 1 else {"parent": first.column("parent").to_numpy(), "link": first.column("link").to_numpy()}
        out = [rows(MERGED, lang=[blocks.column("lang")[0].as_py()] * found.size, id=ids, a=totals[found], **named)]
        if feeds:
            number = np.full(totals.size, GAP)
            number[found] = np.arange(found.size)
            of = np.empty(order.size, np.int64)
            of[order] = np.repeat(number, np.diff(np.append(starts, order.size)))
            node, back, at = table.column("node").to_numpy(), [], 0
            for shard, t in zip(blocks.column("shard").to_pylist(), tables, strict=True):
                k = np.flatnonzero(of[at : at + t.num_rows] >= 0) + at
                at += t.num_rows
                if k.size:
                    back.append((shard, packed({"node": pa.array(node[k]), "id": pa.array(ids[of[k]]), "total": pa.array(totals[found][of[k]])})))
            if back:
                out.append(rows(MERGED, shard=[s for s, _ in back], block=[b for _, b in back]))
        return pa.Table.from_batches(out)

    return level.where("not is_text").select("lang", "range", "shard", "parents", "block").groupBy("lang", "range").applyInArrow(merge, MERGED)


def next_level(level: DataFrame, back: DataFrame, ranges: int) -> DataFrame:
    """Every shard's nodes of one word more, from its text in nodes and what came back of those."""

    def grow(text: pa.Table, back: pa.Table) -> pa.Table:
        if not (text.num_rows and back.num_rows):
            return pa.Table.from_batches([rows(LEVEL, shard=[])])
        known = pa.concat_tables([unpacked(b.as_py()) for b in back.column("block")]).sort_by("id")
        ids, totals, node = (known.column(c).to_numpy() for c in ("id", "total", "node"))
        state = np.frombuffer(zstandard.decompress(text.column("state")[0].as_py()), np.int32)
        place = np.full(max(int(state.max(initial=0)), int(node.max())) + 2, GAP)  # the last stands for gaps
        place[node] = np.arange(node.size)
        here = place[state]
        at = np.flatnonzero((here[:-1] >= 0) & (here[1:] >= 0))
        key, inverse, n = np.unique(here[at] * node.size + here[at + 1], return_inverse=True, return_counts=True)
        parent, link = key // node.size, key % node.size
        state = np.full(here.size, GAP)
        state[at] = inverse
        h = mixed(ids)
        dealt = h[parent] + h[link] % (1 + totals[parent] // SPLIT).astype(np.uint64)
        nodes = Nodes(ids[parent], pa.array(ids[link]), n.astype(np.int64))
        return pa.Table.from_batches(list(level_rows(text.column("lang")[0].as_py(), text.column("shard")[0].as_py(), state, None, nodes, (dealt % np.uint64(ranges)).astype(np.int64))))

    texts = level.where("is_text").select("lang", "shard", "state")
    return texts.groupBy("shard").cogroup(back.where("block is not null").select("shard", "block").groupBy("shard")).applyInArrow(grow, LEVEL)


def walked(found: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes of the merged trie with their phrases and the counts of their parts, from those of the level above: by the walk from the parent, and by the suffix link."""
    parents = above.select("lang", F.col("id").alias("parent"), F.col("phrase").alias("p"), F.concat("lefts", F.array("a")).alias("lefts"))
    links = above.select("lang", F.col("id").alias("link"), F.substring_index("phrase", " ", -1).alias("last"), F.concat(F.array("a"), "rights").alias("rights"))
    joined = found.join(parents, ["lang", "parent"]).join(links, ["lang", "link"])
    return joined.select("lang", "id", F.concat_ws(" ", "p", "last").alias("phrase"), "a", "lefts", "rights")


def phrases_of(docs: DataFrame, longest: int, least: int, work: Scratch, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, d, a, lefts, rights of all phrases of 2 to `longest` words that occur `least` times; and lang, n: all words."""
    prepare(docs.sparkSession)
    ranges = max(RANGES_A_PART * docs.rdd.getNumPartitions(), 1)
    level = work.save(first_level(docs, ranges, shard_words), "level1")
    words = work.save(level.where("is_text").groupBy("lang").agg(F.sum("words").alias("n")), "words")
    none, whole = F.array().cast("array<bigint>"), None
    for d in range(1, longest + 1):
        back = work.save(merged(level, d, least, d < longest), f"merged{d}")
        found = back.where("id is not null")
        nodes = found.select("lang", "id", "phrase", "a", none.alias("lefts"), none.alias("rights")) if d == 1 else walked(found.drop("phrase"), nodes)
        nodes = work.save(nodes, f"nodes{d}")
        if d > 1:
            of_d = nodes.select("lang", "phrase", F.lit(d).alias("d"), "a", "lefts", "rights")
            whole = of_d if whole is None else whole.unionByName(of_d)
        if d < longest:
            level = work.save(next_level(level, back, ranges), f"level{d + 1}")
        work.drop(f"level{d}", f"merged{d}")
        work.release()
    return whole, words


def mine(docs: DataFrame, longest: int = 4, least: int = 30, top: int = 2000, cover: int = 80, work: Scratch | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases.

    Null texts are empty, a null lang is `und`. Repeated rows count each. A phrase of equal score and count comes in the order of its bytes; of cuts of equal
    score the first counts. A phrase is dropped if a longer one that occurs `least` times holds it in at least `cover` % of its occurrences.
    An empty table, or one without words, gives no row. Other columns are ignored.
    """
    work = work or Scratch(docs.sparkSession, "phrases")
    found, words = phrases_of(docs, longest, least, work, shard_words)
    # if a longer phrase covers one, so does that of one word more between them: it is at least as frequent
    short = lambda sign: F.expr(f"substring_index(phrase, ' ', {sign}(d - 1))")
    covers = found.where("d > 2").select("lang", F.explode(F.array(short("+"), short("-"))).alias("phrase"), F.col("a").alias("longer"))
    covers = covers.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    whole = lambda c: F.col(c).cast("decimal(20,0)")
    left = found.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * whole("longer") < cover * whole("a")))
    cut = "transform(sequence(1, d - 1), k -> struct((2000000bd * a) div (cast(lefts[k - 1] as decimal(20,0)) + rights[k - 1]) as score, k as k, lefts[k - 1] as l, rights[k - 1] as r))"
    scored = left.withColumn("cut", F.array_min(F.expr(cut))).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scored.withColumn("rank", order).where(F.col("rank") <= top)
    return best.join(small(words, 64), "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the phrases of all documents."""
    return mine(spark.read.parquet(f"{sf_dir}/documents.parquet"))
