"""Aggregates in Python in two phases: what a task has seen of a key is one small state before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trimmed_means(df: DataFrame, key: str, value: str, share: float, width: float) -> DataFrame:
    """key, n, trimmed: the mean of a key's values without the lowest and the highest `share` of them, by a histogram of steps of `width`.

    A state is a key's counts and sums by step; states of one key and step are added by Spark, and each key's steps, not its rows, are
    gathered at the end. Exact where the cuts fall between steps; a step that is cut gives its mean for each value it keeps. Nulls and NaN aren't
    counted; a null key is a key.
    """
    kind = df.schema[key].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).to_numpy(zero_copy_only=False)
            codes = batch.column(0).dictionary_encode()
            keys = np.where(batch.column(0).is_valid(), codes.indices.fill_null(-1).to_numpy(zero_copy_only=False), -1).astype(np.int64)
            ok = ~np.isnan(v)
            steps = np.floor(v[ok] / width).astype(np.int64)
            cells, at = np.unique(np.stack([keys[ok], steps]), axis=1, return_inverse=True)
            at = at.reshape(-1)
            n, s = np.bincount(at, minlength=cells.shape[1]), np.bincount(at, weights=v[ok], minlength=cells.shape[1])
            names = codes.dictionary.take(pa.array(np.where(cells[0] < 0, 0, cells[0]), mask=cells[0] < 0))
            yield pa.RecordBatch.from_arrays([names, pa.array(cells[1]), pa.array(n, pa.int64()), pa.array(s)], names=["key", "step", "n", "s"])

    def finish(group: pa.Table) -> pa.Table:
        group = group.sort_by("step")
        n, s = group.column("n").to_numpy(), group.column("s").to_numpy()
        total, ends = n.sum(), np.cumsum(n)
        low, high = np.floor(share * total), total - np.floor(share * total)
        kept = np.clip(np.minimum(ends, high) - np.maximum(ends - n, low), 0, None)
        mean = float((kept * s / n).sum() / kept.sum()) if kept.sum() else None
        return pa.table({"key": group.column("key").slice(0, 1), "n": pa.array([int(total)]), "trimmed": pa.array([mean], pa.float64())})

    states = df.select(F.col(key).alias("key"), F.col(value).cast("double").alias("v")).mapInArrow(partial, f"key {kind}, step bigint, n bigint, s double")
    return states.groupBy("key", "step").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).groupBy("key").applyInArrow(finish, f"key {kind}, n bigint, trimmed double").select(F.col("key").alias(key), "n", "trimmed")
