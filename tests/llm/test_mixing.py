from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F
from llm.helpers import ODD, documents

from loomshed.llm.mixing import mix, query, words_in

SIZED = "doc_id bigint, source string, size bigint"


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0):
    """Rounds of sharing until no target is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_words(spark):
    got = {r.doc_id: r.n for r in documents(spark, ODD).select("doc_id", words_in().alias("n")).collect()}
    assert got == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(ODD)}


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_copies(spark, seed):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "Z", "empty"]
    rows = [(k, s, 0 if s == "empty" else rng.choice([0, 1, 7, 50, 400])) for k in range(900) for s in [rng.choices(sources, [9, 3, 2, 1, 1, 1])[0]]]
    rows += [rows[0]] * 5 + [(None, "a", 12)] * 3
    df = spark.createDataFrame(rows, SIZED).withColumn("target", F.lit("clash"))
    got = mix(df, seed=seed).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((i or -1, n) for i, _, n in rows)
    source = {i: s for i, s, _ in rows}
    sizes, taken, target, largest = {}, {}, {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r.copies in (0, 1, 2) and (r["size"] or not r.copies)
        sizes[s] = sizes.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r.copies * r["size"]
        largest[s] = max(largest.get(s, 0), r["size"])
        target[s] = r.target
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
        assert all(r.source_size == sizes[s] for r in got if source[r.doc_id] == s)


def test_same_rows_same_copies(spark):
    rng = random.Random(5)
    rows = [(k, f"s{k % 4}", rng.randrange(1, 300)) for k in range(500)]
    a = {r.doc_id: r.copies for r in mix(spark.createDataFrame(rows, SIZED)).collect()}
    rng.shuffle(rows)
    assert a == {r.doc_id: r.copies for r in mix(spark.createDataFrame(rows, SIZED).repartition(7)).collect()}
    assert mix(spark.createDataFrame([], SIZED)).count() == 0
    assert {r.copies for r in mix(spark.createDataFrame([(1, "a", 0), (2, None, 0)], SIZED)).collect()} == {0}


def test_rounding_is_fair(spark):
    """Over many seeds each document of a source gets its probability."""
    df, n = spark.createDataFrame([(k, "ab"[k % 2], 10 + k) for k in range(12)], SIZED).cache(), 60
    sums = {k: 0 for k in range(12)}
    for seed in range(n):
        for r in mix(df, seed=1000 * seed, weights=(1, 1), share=0.5).collect():
            sums[r.doc_id] += r.copies
    mean = sum(sums.values()) / n / 12
    assert 0.4 < mean < 0.6 and all(0.2 < s / n < 0.8 for s in sums.values())


def test_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = query(spark, "/root/testdata/sf0.01").collect()
    sizes = {}
    for r in docs.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    want = brute_targets(sizes)
    assert len(got) == len(docs) and all(abs(r.target - want[docs[r.doc_id].source]) < 1e-6 * r.target and r.taken <= 2 * r["size"] for r in got)
