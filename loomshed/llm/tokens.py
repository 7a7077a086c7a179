"""Token counts and ids as the tokenizers library gives them, huge texts in overlapping chunks.

Short texts are encoded whole. A huge text is encoded in chunks that overlap. A boundary between two
pre-tokens that both chunks have at the same place, far enough from either chunk's cut, is proven: the
splitting pattern reads from left to right and starts anew at each boundary, so what follows depends on
the text from there on alone. The chunks are spliced at such a boundary; where there is none, the overlap
is widened, at last to the rest of the text. Tokenizers whose pieces aren't byte-level get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_text, prepare, slices

HUGE = 1 << 16
OVERLAP = 1 << 10
#: What counting takes for huge: so many characters make a chunk, and so many two chunks have in common at first.
CHUNK, COMMON = 1 << 12, 1 << 7


def boundaries(encoding) -> dict[int, int]:
    """Offset -> number of tokens before it, where a pre-token starts."""
    words, offsets = encoding.word_ids, encoding.offsets
    return {offsets[k][0]: k for k in range(len(words)) if k == 0 or words[k] != words[k - 1]}


def byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level vocabulary whose merges are in the order of their ids; None of any other."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    vocabulary, merges = model.get("vocab", {}), [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    made = [vocabulary.get("".join(m), -1) for m in merges]
    singles = [vocabulary.get(c, -1) for c in byte_of]
    if model.get("ignore_merges") or model.get("dropout") or not made or min(made) <= max(singles) or min(singles) < 0 or any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    return {bytes(map(byte_of.__getitem__, w)): k for w, k in vocabulary.items() if all(c in byte_of for c in w)}


class Tokens:
    """ids(text) of one tokenizer file: .json by tokenizers, .model by sentencepiece."""

    def __init__(self, path: str, huge: int = HUGE, overlap: int = OVERLAP):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.huge, self.overlap, self.fast, self.byte_level = huge, overlap, None, False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.whole = lambda t: model.encode(t, num_threads=1) if t else []
            return
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.whole = lambda t: self.library.encode(t, add_special_tokens=False).ids
        said = json.loads(self.library.to_str())
        split = said["pre_tokenizer"] or {}
        self.byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not said["normalizer"]
        added = [x["content"] for x in said["added_tokens"]]
        self.byte_level = self.byte_level and not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in said["added_tokens"])
        #: A cut inside an added token, or in a run of white space, changes what stands just before it.
        self.margin = max([2, *map(len, added)]) + 2
        ranks = byte_ranks(said["model"]) if self.byte_level else None
        if ranks:
            self.fast = self.same_ranks(ranks, {x["content"]: x["id"] for x in said["added_tokens"]})

    def same_ranks(self, ranks: dict[bytes, int], added: dict[str, int]):
        """The same vocabulary in a faster encoder, for texts on whose characters both patterns surely agree."""
        import public_tokenizers
        import tiktoken

        ranks = {w: k for w, k in ranks.items() if k not in added.values()}
        plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        odd = re.compile("[^\x00-˿]")
        return lambda t: None if odd.search(t) else plain.encode(t, allowed_special="all")

    def ids(self, text: str) -> list[int]:
        if self.byte_level and len(text) > self.huge:
            return self.spliced(text)
        return self.fast and self.fast(text) or self.whole(text)

    def spliced(self, text: str) -> list[int]:
        """Chunks of `huge` characters, each encoded with its offsets and joined to the one before."""
        out: list[int] = []
        start, base = 0, 0  # the present chunk's place, and its first id that counts
        now = self.library.encode(text[: self.huge], add_special_tokens=False)
        stop = min(self.huge, len(text))
        while stop < len(text):
            marks, overlap = boundaries(now), self.overlap
            while True:
                begin = max(start, stop - overlap)
                end = min(len(text), begin + max(self.huge, 2 * overlap))
                new = self.library.encode(text[begin:end], add_special_tokens=False)
                theirs = boundaries(new)
                last = stop - self.margin
                both = [p for p in theirs if begin < p + begin <= last and marks.get(p + begin - start, -1) >= base]
                if both:
                    cut = both[-1]
                    out += now.ids[base : marks[cut + begin - start]]
                    start, stop, base, now = begin, end, theirs[cut], new
                    break
                if begin == start:  # the overlap is the whole chunk: take a longer one instead
                    stop = min(len(text), start + 2 * (stop - start))
                    now = self.library.encode(text[start:stop], add_special_tokens=False)
                    break
                overlap *= 2
        return out + now.ids[base:]


@lru_cache(maxsize=4)
def tokens(path: str, huge: int = HUGE, overlap: int = OVERLAP) -> Tokens:
    """One per worker process and file."""
    return Tokens(path, huge, overlap)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, text: str = "text", huge: int = CHUNK, overlap: int = COMMON) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    tokenizer: a file's name under public_tokenizers, or a path that every executor has. Null texts count as
    empty (0 tokens); repeated rows stay; other columns are ignored. Texts of more than `huge` characters are encoded
    in chunks that have `overlap` characters in common at first.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(tokenizer if os.sep in tokenizer else tokenizer_path(tokenizer), huge, overlap)
        for batch in slices(batches, "__text"):
            n = np.fromiter((len(t.ids(x)) for x in batch.column("__text").to_pylist()), np.int64, batch.num_rows)
            size = pa.compute.cast(pa.compute.binary_length(batch.column("__text")), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", as_text(text).alias("__text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: token counts of every document."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
