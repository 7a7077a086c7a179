"""Two tokenizers' tokens of the same texts, aligned by bytes.

A whole Arrow batch is one string of bytes, each document at its offset. The ends of both tokenizers' tokens are counted in it
once, by one bincount: a byte that ends a token of both counts two and cuts a group, and between two ends of any kind
there is one pair of tokens that overlap. Prefix sums over the batch, taken at the documents' ends, give each document its numbers.

How many documents link a pair of ids is counted over all of them: distinct pairs of a document, summed by task, then by
Spark. The commonest pairs, a fixed number, are sent to every task, where most links find theirs; all others are joined.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, Scratch, as_text, slices
from .suffix_tree import commonest, find, merged
from .tokens import byte_ranks, tokenizer_path

#: Pairs that are sent to every task, at most: 16 bytes each.
MOST_PAIRS = MOST_SENT // 16
#: Text that is aligned at once.
BATCH_BYTES = 4 << 20
#: Distinct chunks of text whose ids a worker keeps, and their longest.
MOST_CHUNKS, LONGEST_CHUNK = 1 << 18, 64
#: On all other characters the libraries' splitting patterns agree, character by character (see tests).
RARE = re.compile("[^\x00-˿]")


class Chunks(dict):
    """chunk -> its ids, or None if they don't spell it: a text's ids are those of its chunks, one after the other."""

    def __init__(self, split: Callable[[str], list[str]], encode: Callable[[str], list[int]], bytes_of: list[bytes]):
        super().__init__()
        self.split, self.encode, self.bytes_of = split, encode, bytes_of

    def __missing__(self, chunk: str) -> list[int] | None:
        ids = self.encode(chunk)
        if b"".join(map(self.bytes_of.__getitem__, ids)) != chunk.encode():
            ids = None
        if len(chunk) <= LONGEST_CHUNK:
            if len(self) >= MOST_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        parts = list(map(self.__getitem__, self.split(text)))
        return [] if None in parts else list(chain.from_iterable(parts))


class Side:
    """ids of a space and a text by one tokenizer file, and the bytes that each id stands for."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        #: Of texts without RARE characters: ids that surely spell the text.
        self.fast: Callable[[str], list[int]] | None = None
        self.bytes_of = self.pieces(path) if path.endswith(".model") else self.library(path)
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)
        decimal = [str(k).encode() for k in range(len(self.bytes_of))]
        #: Each id in decimal with what stands behind it: within its side of a group, and at the side's end.
        self.inner = [x + b"," for x in decimal]
        self.decimal = decimal

    def library(self, path: str) -> list[bytes]:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        library.encode_special_tokens = True
        self.whole = lambda text: library.encode(" " + text, add_special_tokens=False).ids
        said = json.loads(library.to_str())
        split = said["pre_tokenizer"] or {}
        ranks = byte_ranks(said["model"]) if split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not said["normalizer"] else None
        if ranks:
            import public_tokenizers
            import tiktoken

            added = {x["id"] for x in said["added_tokens"]}
            plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks={w: k for w, k in ranks.items() if k not in added}, special_tokens={})
            self.fast = lambda text: plain.encode_ordinary(" " + text)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        tokens = [library.id_to_token(k) or "" for k in range(library.get_vocab_size())]
        return [bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode() for t in tokens]

    def pieces(self, path: str) -> list[bytes]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = lambda text: model.encode(text, num_threads=1)
        pieces = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        plain = [not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k)) for k in range(len(pieces))]
        spelled = [bytes([int(x[3:5], 16)]) if model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        # merges make nothing that isn't a piece: where no piece goes across, a text can be cut
        if not any(p and re.search("[^▁]▁|\n", x) for p, x in zip(plain, pieces, strict=True)):
            line = model.encode("\n", num_threads=1)
            after = lambda chunk: model.encode("\n" + chunk, num_threads=1)[len(line) :]
            pattern = re.compile(" +[^ \n]*|\n|[^ \n]+")
            self.fast = Chunks(lambda text: pattern.findall(" " + text), lambda chunk: model.encode(chunk[1:], num_threads=1) if len(chunk) > 1 and chunk[0] == " " else after(chunk), spelled).ids
        return spelled

    def ids(self, text: str) -> list[int]:
        """No ids if they don't spell the space and the text."""
        if not text:
            return []
        if self.fast and not RARE.search(text):
            return self.fast(text)
        found = self.whole(text)
        return found if b"".join(map(self.bytes_of.__getitem__, found)) == b" " + text.encode("utf-8", "surrogatepass") else []


@lru_cache(maxsize=4)
def side(name: str) -> Side:
    """One per worker process and file."""
    return Side(name if os.sep in name else tokenizer_path(name))


@lru_cache(maxsize=2)
def spelling(a: str, b: str) -> np.ndarray:
    """Ids in decimal: A's within a side of a group, A's at its end, and so B's."""
    a, b = side(a), side(b)
    return np.array([*a.inner, *(x + b"|" for x in a.decimal), *b.inner, *(x + b";" for x in b.decimal)], object)


class Aligned:
    """A batch of texts: for each n_a, n_b, n_groups, n_links and the groups' digest; its linked pairs (a * B's vocabulary + b) with their times."""

    def __init__(self, texts: list[str], a: str, b: str):
        one, other = side(a), side(b)
        of_a, of_b = [one.ids(t) for t in texts], [other.ids(t) for t in texts]
        both = [bool(x and y) for x, y in zip(of_a, of_b, strict=True)]
        of_a, of_b = ([x if k else [] for x, k in zip(of, both, strict=True)] for of in (of_a, of_b))
        flat = lambda lists, n: np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum()))
        self.n_a, self.n_b = (np.array([len(x) for x in of], np.int64) for of in (of_a, of_b))
        ids_a, ids_b = flat(of_a, self.n_a), flat(of_b, self.n_b)
        ends_a, ends_b = np.cumsum(one.sizes[ids_a]), np.cumsum(other.sizes[ids_b])
        size = int(ends_a[-1]) if ends_a.size else 0
        document_ends = np.append(0, ends_a)[np.cumsum(self.n_a)]

        ends = np.bincount(np.concatenate([ends_a, ends_b]), minlength=size + 1)
        at = np.flatnonzero(ends)
        shared = ends[at] == 2
        ends_of_a = np.zeros(size + 1, bool)
        ends_of_a[ends_a] = True
        ends_a_here = ends_of_a[at]
        ends_b_here = ~ends_a_here | shared
        before = lambda flags: np.cumsum(flags) - flags
        group = before(shared)
        stops = np.searchsorted(at, document_ends, "right")
        self.n_links = np.diff(stops, prepend=0)
        self.n_groups = np.diff(np.append(0, np.cumsum(shared))[stops], prepend=0)

        pair = ids_a[before(ends_a_here)] * other.sizes.size + ids_b[before(ends_b_here)] if at.size else at
        document = np.repeat(np.arange(len(texts)), self.n_links)
        span = one.sizes.size * other.sizes.size
        key, self.times = np.unique(document * span + pair, return_counts=True)
        self.pairs, self.n_pairs = key % span, np.bincount(key // span, minlength=len(texts))

        # a token's place: behind those of its side, and of the other side's those of earlier groups (for B, of its own too)
        last_a, last_b = np.flatnonzero(ends_a_here), np.flatnonzero(ends_b_here)
        group_a, group_b = group[last_a], group[last_b]
        groups = int(shared.sum())
        per_a, per_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        said = np.empty(ids_a.size + ids_b.size, np.int64)
        said[np.arange(ids_a.size) + before(per_b)[group_a]] = ids_a + one.sizes.size * shared[last_a]
        said[np.arange(ids_b.size) + np.cumsum(per_a)[group_b]] = 2 * one.sizes.size + ids_b + other.sizes.size * shared[last_b]
        words, stops = spelling(a, b)[said].tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        self.digests = [hashlib.sha256(b"".join(words[i:j])[:-1]).hexdigest() if j > i else "" for i, j in zip([0, *stops], stops, strict=False)]


def pieces_of(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters."""
    first = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, k
            first, size = k, 0
        size += len(t)
    if len(texts) > first:
        yield first, len(texts)


def align_texts(docs: DataFrame, a: str, b: str, work: Scratch) -> DataFrame:
    """Two kinds of rows. Of each document: doc_id, its numbers, and its linked pairs with their times. Of each task's pairs: pair, n documents."""
    kind = docs.schema["doc_id"].dataType
    source = docs.select(F.col("doc_id"), as_text("text").alias("text"))
    schema = f"is_pair boolean, doc_id {kind.simpleString()}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<int>, pair bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, names, kinds = [], [], None, None

        def counted() -> pa.RecordBatch:
            k, n = merged(keys, counts)
            keys.clear()
            counts.clear()
            return rows({"is_pair": pa.array(np.ones(k.size, bool)), "pair": pa.array(k), "n": pa.array(n)}, k.size)

        def rows(columns: dict, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[c].cast(t) if c in columns else pa.nulls(size, t) for c, t in zip(names, kinds, strict=True)], names=names)

        for batch in slices(batches, most=BATCH_BYTES):
            if names is None:
                names = [x.split(" ")[0] for x in schema.split(", ")]
                kinds = [pa.bool_(), batch.schema.field("doc_id").type, *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int64()]
            texts = batch.column("text").to_pylist()
            for i, j in pieces_of(texts, BATCH_BYTES):
                x = Aligned(texts[i:j], a, b)
                offsets = pa.array(np.append(0, np.cumsum(x.n_pairs)), pa.int32())
                yield rows({
                    "is_pair": pa.array(np.zeros(j - i, bool)), "doc_id": batch.column("doc_id").slice(i, j - i), "n_a": pa.array(x.n_a), "n_b": pa.array(x.n_b), "n_groups": pa.array(x.n_groups), "n_links": pa.array(x.n_links),
                    "groups_sha256": pa.array(x.digests, pa.string()), "pairs": pa.ListArray.from_arrays(offsets, pa.array(x.pairs, pa.int64())), "times": pa.ListArray.from_arrays(offsets, pa.array(x.times, pa.int32())),
                }, j - i)
                k, n = np.unique(x.pairs, return_counts=True)
                keys.append(k)
                counts.append(n)
                if sum(map(len, keys)) > 3_000_000:
                    k, n = merged(keys, counts)
                    keys[:], counts[:] = [k], [n]
                    if k.size > 1_500_000:
                        yield counted()
        if names is not None:
            yield counted()

    return work.save(source.mapInArrow(run, schema), "aligned")


def counted_pairs(aligned: DataFrame, vocabulary: int, work: Scratch) -> DataFrame:
    """pair, n, best: of every linked pair the number of documents, and whether no other pair of its A id has more. A's ids are the keys of what is sent."""
    pairs = work.save(aligned.where("is_pair").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    best = pairs.groupBy(F.floor(F.col("pair") / vocabulary).alias("a")).agg(F.max("n").alias("most"))
    return work.save(pairs.withColumn("a", F.floor(F.col("pair") / vocabulary)).join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", most_pairs: int = MOST_PAIRS, work: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    a, b: files under public_tokenizers, or paths that every executor has. Null and empty texts, and those that either tokenizer's
    tokens don't spell, have no tokens: zeros and an empty digest. Repeated rows stay and count each; an empty table gives no row;
    other columns are ignored. A link is best if as many documents have its pair as any pair of its A id; ties are.
    """
    work = work or Scratch(docs.sparkSession, "align")
    aligned = align_texts(docs, a, b, work)
    pairs = counted_pairs(aligned, side(b).sizes.size, work)
    floor = commonest(pairs.select("n", F.lit(1).alias("weight")), most_pairs, 1)
    head = pairs.where(F.col("n") >= floor).toArrow()
    order = np.argsort(head.column("pair").to_numpy())
    known, signed = head.column("pair").to_numpy()[order], np.where(head.column("best").to_numpy(), -1, 1)[order] * head.column("n").to_numpy()[order]
    sent = docs.sparkSession.sparkContext.broadcast((known, signed))  # a best pair's count is negative

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, signed = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            document = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(pairs).to_numpy(zero_copy_only=False))
            pairs = pairs.flatten().to_numpy()
            k, there = find(known, pairs)
            n = signed[k[there]]
            summed = lambda x: pa.array(np.bincount(document[there], weights=x, minlength=batch.num_rows).astype(np.int64))  # noqa: B023, E731
            rest = pa.StructArray.from_arrays([pa.array(pairs[~there]), pa.array(times[~there])], names=["pair", "times"])
            rest = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(document[~there], minlength=batch.num_rows))), pa.int32()), rest)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), summed(times[there] * (n < 0)), summed(times[there] * np.abs(n)), rest], names=[*kept, "best", "total", "rest"])

    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kinds = ", ".join(f"{c} {aligned.schema[c].dataType.simpleString()}" for c in kept)
    found = aligned.where("not is_pair").select(*kept, "pairs", "times").mapInArrow(look, f"{kinds}, best bigint, total bigint, rest array<struct<pair:bigint,times:int>>")
    found = work.save(found.withColumn("row", F.monotonically_increasing_id()), "found")
    work.drop("aligned", "counts")
    others = found.select("row", F.explode("rest").alias("x")).select("row", "x.*").join(pairs.where(F.col("n") < floor), "pair")
    others = others.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("bigint")
    return found.join(others, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("best", "more_best").alias("n_best"), plus("total", "more").alias("count_sum"), "groups_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: both tokenizers' tokens of every document."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
