from __future__ import annotations

import numpy as np
import pytest
from llm.helpers import components
from pyspark.sql import functions as F

from loomshed.llm.embedding_dedup import Caps, near_vectors, query, summary, unit

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, least=0.98):
    sound = [(k, i, np.array(x, float), y) for k, (i, x, y) in enumerate(rows) if x is not None and y is not None and len(x) and all(v is not None and np.isfinite(v) for v in x) and any(x)]
    links = [(a, b) for a, _, x, y in sound for b, _, z, w in sound if a < b and y == w and len(x) == len(z) and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= least]
    root = components(links, range(len(rows)))
    n = [sum(k in p for p in links) for k in range(len(rows))]
    ids = {c: min((rows[k][0] for k in root if root[k] == c and rows[k][0] is not None), default=None) for c in set(root.values())}
    return sorted((str(rows[k][0]), n[k], str(ids[root[k]]), rows[k][0] == ids[root[k]]) for k in root)


def vectors(seed: int, n: int, dim: int = 64):
    """Groups around centres at distances on both sides of the limit, and loners."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((max(1, n // 20), dim))
    rows = []
    for k in range(n):
        x = centres[rng.integers(len(centres))] if k % 3 else rng.standard_normal(dim)
        x = x / np.linalg.norm(x) + rng.standard_normal(dim) / dim**0.5 * rng.choice([0.02, 0.1, 0.14, 0.2])
        rows.append((int(k), [float(v) for v in (x * rng.choice([0.1, 1, 30])).astype(np.float32)], int(k % 2)))
    return rows


def same(spark, rows, **more):
    got = near_vectors(spark.createDataFrame(rows, VECTORS), **more).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(rows)


def test_links_and_components(spark):
    rows = vectors(0, 500)
    hot = vectors(1, 3)[1][1]
    rows += [(1000 + k, [v + 1e-4 * (k % 7) for v in hot], 0) for k in range(150)]
    same(spark, rows)


def test_other_dimensions_and_odd_rows(spark):
    rows = vectors(2, 80, 5) + [(500 + i, x, y) for i, x, y in vectors(3, 40, 7)]
    rows += [(900, None, 1), (901, [0.0] * 5, 1), (902, [], 1), (903, [1.0, None, 1.0, 1.0, 1.0], 1), (904, [float("nan")] * 5, 1), (905, [float("inf")] * 5, 1), (906, rows[0][1], None), rows[0], (None, rows[0][1], rows[0][2])]
    same(spark, rows, caps=Caps(words=8, mean=60, least=60))
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_decoding_finds_all_filters_above_the_threshold():
    caps, rng = Caps(words=6, mean=30, least=10), np.random.default_rng(4)
    x = rng.standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books, size = caps.codebooks(10), 3
    padded = np.zeros((20, 12))
    padded[:, :10] = x
    for row, got in zip(padded, caps.decode(x), strict=True):
        s = [books[b] @ row[b * size : (b + 1) * size] for b in range(4)]
        scores = (s[0][:, None, None, None] + s[1][None, :, None, None] + s[2][None, None, :, None] + s[3]).ravel()
        t = caps.threshold(10)
        while (scores >= t).sum() < 10:
            t -= 0.02
        assert got.tolist() == np.flatnonzero(scores >= t - 1e-12).tolist()


def test_summary():
    t = summary(np.array([1, 2, 8]), np.array([2, 3, 9])).to_pydict()
    assert t == {"row": [1, 2, 3, 8, 9], "n": [1, 2, 1, 1, 1], "root": [1, 1, 1, 8, 8]}


def pairs_at(seed: int, n: int, cosine: float, dim: int = 64):
    rng = np.random.default_rng(seed)
    a, b = unit(rng.standard_normal((n, dim))), rng.standard_normal((n, dim))
    b = unit(b - (a * b).sum(1)[:, None] * a)
    return a, cosine * a + (1 - cosine * cosine) ** 0.5 * b


@pytest.mark.parametrize("words", [32, 64, 128])
def test_recall_by_size_of_the_code(words):
    """Pairs at the limit of 0.98 share a filter, whatever the code's size: none of 4,000 is lost."""
    a, b = pairs_at(words, 4000, 0.98)
    caps = Caps(words=words)
    assert all(np.intersect1d(x, y, assume_unique=True).size for x, y in zip(caps.lists(a), caps.lists(b), strict=True))


def test_links_of_a_large_group(spark):
    """A thousand near copies around one vector and 3,000 others, against brute force."""
    rng = np.random.default_rng(6)
    hot = rng.standard_normal(64)
    x = np.concatenate([hot + rng.standard_normal((1000, 64)) * rng.uniform(0.02, 0.25, (1000, 1)), rng.standard_normal((3000, 64))]).astype(np.float32)
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], VECTORS)).collect()}
    z = unit(x.astype(float))
    assert [got[k] for k in range(len(x))] == ((z @ z.T >= 0.98).sum(1) - 1).tolist() and max(got.values()) > 300


def test_doubles_stay_doubles(spark):
    """Components beyond the range and the precision of floats."""
    base = [1.0] * 8
    rows = [(0, [v * 1e300 for v in base], 1), (1, [v * 1e-300 for v in base], 1), (2, base, 1), (3, [-1.0] + base[1:], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).orderBy("vec_id").collect()
    assert [(r.n_links, r.component_id, r.kept) for r in got] == [(2, 0, True), (2, 0, False), (2, 0, False), (0, 3, True)]


def test_equal_vectors_count_each(spark):
    rows = [(k, [1.0, 0.0, 0.0, 0.1 * (k % 2)], k % 3 and 1) for k in range(60)]
    same(spark, rows, caps=Caps(words=8, mean=60, least=60))


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame(vectors(5, 60), VECTORS).withColumns({c: F.lit(c) for c in ("row", "x", "dim", "key", "copies", "h1", "filter", "component", "a.b")})
    got = near_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == brute(vectors(5, 60))


def test_query(spark):
    got = query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"] and got.count() == 500
