"""Secrets in texts: three fixed patterns, and windows of high entropy in candidate strings.

The method slides a window over each candidate and keeps the counts of its characters; the entropy
follows from the counts as one character enters and one leaves, so a window costs a constant.
A candidate is flagged if a window's Shannon entropy reaches a share of what as many random characters of its class
are expected to have. Every candidate is scored, whether or not a pattern has found it or a part of it too.
Allow-listed candidates are left alone.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, prepare, slices

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: Each of these takes the same matches as its `+` form followed by the length test.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: A candidate is a run of these, with what fills up base64.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Classes by pattern and number of characters; the first that matches counts.
CLASSES = ((re.compile(r"[0-9a-f]+|[0-9A-F]+"), 16), (re.compile(r"[a-z0-9]+|[A-Z0-9]+"), 36), (re.compile(r"[A-Za-z0-9]+"), 62), (re.compile(r"[A-Za-z0-9+/_-]+={0,2}"), 64))


@dataclass(frozen=True)
class EntropyRule:
    """Window length, and the least share of the entropy expected of random characters; what the allow list matches is never flagged."""

    window: int = 20
    share: float = 0.88
    #: Words, paths, identifiers, numbers, times, UUIDs and filler: a secret needs digits and letters mixed closely. Neighbouring repeats take
    #: different characters, so that a run can be split in one way only and a match takes time in proportion to the text.
    allow: tuple[str, ...] = (
        r"[A-Za-z]+[0-9]{0,4}", r"[0-9]+", r"[=_+/-]+", r"(.)\1+", r"(?=[A-Za-z]*[_/+-])[A-Za-z]*(?:[_/+-]+[A-Za-z]+)*[_/+-]*[0-9]{0,4}=*", r"[0-9TZ]+([_/+-]+[0-9TZ]+)+",
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(?i).*(example|sample|dummy|placeholder|xxxx|changeme).*",
    )


@lru_cache(maxsize=None)
def expected_entropy(symbols: int, n: int) -> float:
    """Mean bits per character of n random characters out of `symbols`."""
    p = 1 / symbols
    return math.log2(n) - symbols / n * sum(math.comb(n, c) * p**c * (1 - p) ** (n - c) * c * math.log2(c) for c in range(1, n + 1))


def peak_entropy(text: str, window: int) -> float:
    """Most bits per character in any window; a shorter text is one window."""
    n = min(window, len(text))
    counts: dict[str, int] = {}
    term = [0.0, *(k * math.log2(k) for k in range(1, n + 1))]
    total = best = 0.0
    for k, c in enumerate(text):
        if k >= n:
            x = counts[text[k - n]]
            total += term[x - 1] - term[x]
            counts[text[k - n]] = x - 1
        x = counts.get(c, 0)
        total += term[x + 1] - term[x]
        counts[c] = x + 1
        if k >= n - 1:
            best = max(best, math.log2(n) - total / n)
    return best


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def entropy_spans(text: str, rule: EntropyRule) -> list[tuple[int, int, int]]:
    """Flagged candidates, as base_spans gives its own."""
    found = []
    for m in CANDIDATE.finditer(text):
        word = m[0]
        if not word.isalpha() and not any(re.fullmatch(p, word) for p in rule.allow):
            symbols = next(n for p, n in CLASSES if p.fullmatch(word))
            if peak_entropy(word, rule.window) >= rule.share * expected_entropy(symbols, min(rule.window, len(word))):
                found.append((m.start(), 3, m.end()))
    return found


def scan_secrets(docs: DataFrame, rule: EntropyRule | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the columns of `keep` and spans array<struct<kind,start,stop>>.

    spans are sorted by start, then kind; they hold code points, ends exclusive. The base spans of the three
    patterns always stay; the entropy method adds its candidates, also where a base span is. Null and empty texts give
    an empty list; repeated rows stay; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rule = rule or EntropyRule()
    column = "__text"
    source = docs.select(*keep, as_text(text).alias(column))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]] + ["spans array<struct<kind:string,start:bigint,stop:bigint>>"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            out = []
            for t in batch.column(column).to_pylist():
                base = base_spans(t)
                out.append([{"kind": KINDS[k], "start": s, "stop": e} for s, k, e in sorted(base + entropy_spans(t, rule))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, kind)], names=[*batch.schema.names[:-1], "spans"])

    return source.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op7: counts and digests of the spans found in every text."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    join = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(join(base).cast("binary"), 256).alias("base_sha256"), join(F.col("spans")).alias("spans"))
