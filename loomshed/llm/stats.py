"""Statistics of whole texts, computed once per document for the quality operators."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_text, prepare, slices, words_of

SYMBOLS = "#*$%&|<>"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_marks", "n_distinct", "n_top", "n_unique_pairs", "n_stops", "byte_bits")
WINDOW = 5
_UPPER, _LOWER, _DIGITS = slice(65, 91), slice(97, 123), slice(48, 58)
_SPACES, _SYMBOLS, _MARKS = [9, 10, 11, 12, 13, 32], [ord(c) for c in SYMBOLS], [ord(c) for c in "!?~^_=+@/\\{}[]"]


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""
    grams = list(zip(*(words[k:] for k in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    counts, inside = Counter(grams), bytearray(len(words))
    for k, g in enumerate(grams):
        if counts[g] > 1:
            inside[k : k + window] = b"\1" * window
    return sum(inside)


def text_stats(text: str) -> tuple:
    """The values of COLUMNS for one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by = np.bincount(raw, minlength=256)
    words = words_of(text)
    counts = Counter(words)
    # all other white space within a line is part of it, so a line without a word is skipped by what its bytes split to
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    p = by[by > 0] / max(1, raw.size)
    return (
        len(words),
        int(raw.size - by[0x80:0xC0].sum() - by[_SPACES].sum()),
        int(by[_SYMBOLS].sum()),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        int(by[_UPPER].sum()),
        int(by[_UPPER].sum() + by[_LOWER].sum() + by[0xC0:].sum()),
        int(by[_DIGITS].sum()),
        int(by[_MARKS].sum()),
        len(counts),
        max(counts.values(), default=0),
        len(set(zip(words, words[1:], strict=False))),
        int(by[[44, 46, 58, 59]].sum()),
        float(-(p * np.log2(p)).sum()) if raw.size else 0.0,
    )


def with_stats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` and the statistics of every row; null texts count as empty."""
    prepare(docs.sparkSession)
    kinds = {c: "double" if c == "byte_bits" else "bigint" for c in COLUMNS}
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.DoubleType() if k == "double" else T.LongType()) for c, k in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            values = list(zip(*map(text_stats, batch.column("__text").to_pylist()), strict=True))
            made = [pa.array(v, pa.float64() if k == "double" else pa.int64()) for v, k in zip(values, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=[*keep, *kinds])

    return docs.select(*keep, as_text(text).alias("__text")).mapInArrow(run, schema)


def agreed_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label (0 or 1) where all of a document's labels agree; nulls are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    return known.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"), F.max(column).cast("int").alias("__most")).where("label = __most").select("doc_id", "label")
