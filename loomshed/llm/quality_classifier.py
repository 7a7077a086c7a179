"""Regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance that is shrunk towards the pooled one and towards a multiple of the
identity. A score is the logistic of the difference of the classes' log densities and priors; the Mahalanobis
distances come from Cholesky factors that are made once and sent with the scoring task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out_col
from .stats import COLUMNS, agreed_labels, with_stats

#: Rest and modulus of crc32(doc_id) of the rows that training never sees.
HELD_OUT = (4, 2)


def transformed(x: dict[str, np.ndarray]) -> np.ndarray:
    """Features that are roughly normal within a class: logs of ratios to the number of words, and shares."""
    n, lines, letters = np.maximum(x["n_words"], 1), np.maximum(x["n_lines"], 1), np.maximum(x["n_letters"], 1)
    rate = lambda a, b: np.log(a / b + 0.01)
    return np.column_stack([
        np.log1p(x["n_words"]), np.log(x["word_chars"] / n + 0.1), rate(x["n_symbols"], n), rate(x["n_repeat_words"], n), rate(x["n_dup_lines"], lines), rate(x["n_upper"], letters),
        rate(x["n_digits"], n), rate(x["n_marks"], n), rate(x["n_stops"], n), np.log(x["n_distinct"] / n + 0.05), rate(x["n_top"], n), np.log(x["n_unique_pairs"] / n + 0.05), np.log(lines / n), x["byte_bits"],
    ]).astype(float)


def forward(factor: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y with factor @ y = b, for a lower triangular factor: row by row, all columns of b at once."""
    y = np.empty_like(b)
    for k in range(len(factor)):
        y[k] = (b[k] - factor[k, :k] @ y[:k]) / factor[k, k]
    return y


@dataclass
class Discriminant:
    """What scoring needs; mean and scale standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    centres: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        value = []
        for centre, factor, offset in zip(self.centres, self.factors, self.offsets, strict=True):
            y = forward(factor, (z - centre).T)
            value.append(offset - 0.5 * (y * y).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(value[1] - value[0], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_identity: float) -> Discriminant | None:
    """From each class's count, sums and sums of products; None if a class has under two rows."""
    if any(moments.get(k, (0,))[0] < 2 for k in (0, 1)):
        return None
    n = {k: m[0] for k, m in moments.items()}
    means = {k: m[1] / n[k] for k, m in moments.items()}
    scatter = {k: m[2] - n[k] * np.outer(means[k], means[k]) for k, m in moments.items()}
    total = n[0] + n[1]
    pooled = (scatter[0] + scatter[1]) / total
    mean = (moments[0][1] + moments[1][1]) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    unit = np.outer(scale, scale)
    centres, factors, offsets = [], [], []
    for k in (0, 1):
        c = (1 - to_pooled) * scatter[k] / n[k] / unit + to_pooled * pooled / unit
        c = (1 - to_identity) * c + to_identity * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        factors.append(np.linalg.cholesky(c))
        centres.append((means[k] - mean) / scale)
        offsets.append(float(np.log(n[k] / total) - np.log(np.diag(factors[-1])).sum()))
    return Discriminant(mean, scale, centres, factors, offsets)


def class_moments(stats: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per class over all labelled rows: each task sends its own sums, Spark adds them up. As decimals, so that reruns agree to the last bit in whatever order tasks end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            x = transformed({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS})
            y = batch.column("label").to_numpy(zero_copy_only=False)
            for k in np.unique(y):
                own = np.column_stack([np.ones((y == k).sum()), x[y == k]])
                sums[int(k)] = sums.get(int(k), 0) + own.T @ own
        for k, m in sums.items():
            yield pa.RecordBatch.from_pydict({"label": np.full(m.size, k, np.int32), "cell": np.arange(m.size, dtype=np.int32), "value": m.ravel()})

    cells = stats.mapInArrow(run, "label int, cell int, value double").groupBy("label", "cell").agg(F.sum(F.col("value").cast("decimal(38,12)")).cast("double").alias("value")).collect()
    out = {}
    for k in {r.label for r in cells}:
        own = sorted((r.cell, r.value) for r in cells if r.label == k)
        m = np.array([v for _, v in own]).reshape(int(len(own) ** 0.5), -1)
        out[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


def score_quality(docs: DataFrame, labels: DataFrame, cutoff: float = 0.7, to_pooled: float = 0.1, to_identity: float = 0.02, held: tuple[int, int] = HELD_OUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Labels are learnt only from rows that aren't held out. Null texts count as empty and are scored like others;
    repeated rows stay. Contradictory or null labels are left out. Without two labelled rows of either
    class the score is 0.5. Other columns of docs are ignored.
    """
    work = Scratch(docs.sparkSession, "quality")
    stats = work.save(with_stats(docs).withColumn("held_out", held_out_col("doc_id", *held)), "stats")
    model = fit(class_moments(stats.where("not held_out").join(agreed_labels(labels, "quality"), "doc_id").select("label", *COLUMNS)), to_pooled, to_identity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = transformed({c: batch.column(c).to_numpy(zero_copy_only=False) for c in COLUMNS})
            s = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cutoff).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "held_out", *COLUMNS).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every document's score."""
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
