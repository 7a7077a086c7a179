from __future__ import annotations

import random

import numpy as np
import pytest
from llm.helpers import ODD, components, documents, mutated, prose

from loomshed.llm.common import Scratch
from loomshed.llm.components import connected_components
from loomshed.llm.near_dedup import Sketch, WordHashes, near_duplicates, query, shingles, stored


def lowered(text):
    """A-Z alone in lower case; words as they are stated."""
    return (text or "").encode().lower().split()


def brute(texts, size, percent):
    """(n_shingles, component as the smallest doc_id) by comparing all sets."""
    sets = []
    for _, t in texts:
        w = lowered(t)
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = components(links, range(len(sets)))
    least = {c: min((texts[k][0] for k in root if root[k] == c and texts[k][0] is not None), default=None) for c in set(root.values())}
    return [(len(sets[k]), least[root[k]]) for k in range(len(sets))]


def group(seed: int, copies: int, words: int, most: int):
    """A text and copies of it with up to `most` words replaced: links among them are partial."""
    base = prose(seed, words, 10**6)
    return [base] + [mutated(base, seed * 1000 + k, k % (most + 1)) for k in range(copies)]


def corpus():
    texts = list(enumerate([*ODD, *ODD[4:], *(t for s in range(4) for t in group(s, 40, 60 + 25 * s, 7)), *(prose(900 + k, 50) for k in range(60)), "a b c", "A B C", "a b", "a B", "x y z w", "x y z v"]))
    # chains: each text is near the next, the ends aren't
    words = prose(77, 200, 10**6).split(" ")
    texts += [(2000 + k, " ".join(words[4 * k : 4 * k + 120])) for k in range(18)]
    random.Random(1).shuffle(texts)
    return texts + [texts[3], (None, texts[5][1]), (None, "only here and nowhere else")]


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80), (1, 60)])
def test_components_equal_brute_force(spark, size, percent):
    texts = corpus()
    work = Scratch(spark, "test")
    rows = stored(documents(spark, texts).withColumnRenamed("lang", "n").withColumnRenamed("source", "row").repartition(3), work)
    got = near_duplicates(rows, size, percent, work=work).collect()
    want = sorted((str(i), n, str(c)) for (i, _), (n, c) in zip(texts, brute(texts, size, percent), strict=True))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    # one row of each component is first; rows without words are components of their own
    heads = [r for r in got if r.first]
    assert len({(r.component_id, r.doc_id if r.n_shingles == 0 else None) for r in heads}) == len([r for r in heads if r.n_shingles]) + len({r.doc_id for r in got if r.n_shingles == 0})


def test_large_group_of_near_copies(spark):
    """Hundreds of copies, few of which are linked to the same others."""
    texts = list(enumerate(group(5, 600, 90, 9)))
    random.Random(2).shuffle(texts)
    work = Scratch(spark, "test")
    got = {r.doc_id: r.component_id for r in near_duplicates(stored(documents(spark, texts), work), 3, 85, work=work).collect()}
    assert got == {i: c for (i, _), (_, c) in zip(texts, brute(texts, 3, 85), strict=True)}


def test_empty_table(spark):
    work = Scratch(spark, "test")
    assert near_duplicates(stored(documents(spark, ["x"]).limit(0), work), work=work).count() == 0


def test_sketch_agrees_as_often_as_the_sets(spark):
    """Bins of two sets agree with the probability of their similarity, also where most are borrowed."""
    rng, sketch = np.random.default_rng(0), Sketch(rows=1)
    for n, similarity in ((2000, 0.85), (40, 0.6), (6, 0.5)):
        both = round(2 * n * similarity / (1 + similarity))
        agree = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
            agree.append((sketch.bands(a, sketch.probes()) == sketch.bands(b, sketch.probes())).mean())
        assert abs(np.mean(agree) - both / (2 * n - both)) < 0.05


def test_shingles():
    known = WordHashes()
    n = lambda t, size: shingles(t, size, known).size
    assert (n("", 3), n(" \n", 3), n("a", 3), n("a b", 3), n("a b c", 3), n("a b c a b c", 3), n("A\tb\x0bC", 3)) == (0, 0, 1, 1, 1, 3, 1)
    assert shingles("a b", 3, known) != shingles("b a", 3, known)
    assert (shingles("É a b", 3, known) != shingles("é a b", 3, known)).all()


def test_connected_components(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(500, k) for k in range(501, 700)] + [(7, 7), (9, 8), (8, 9)]
    nodes = {x for p in pairs for x in p}
    got = connected_components(spark.createDataFrame(pairs, "a bigint, b bigint"), Scratch(spark, "test")).collect()
    assert {r.node: r.component for r in got} == components(pairs, nodes) and len(got) == len(nodes)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {i: (n, c, i == c) for (i, _), (n, c) in zip(docs, brute(docs, 3, 85), strict=True)}
