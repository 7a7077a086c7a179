from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm.helpers import ODD, documents, prose
from tokenizers import Tokenizer

from loomshed.llm.packing import cut, match_large, pack, plan_packing, query


def check(rows, capacity):
    """No overlaps, no gaps, nothing over capacity."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [7, 48, 300])
def test_plan_places_every_piece_once(capacity):
    rng = random.Random(capacity)
    for n in (0, 1, 5, 300):
        sizes = np.array([rng.choice([rng.randint(1, capacity), capacity, 1, capacity // 2]) for _ in range(n)], np.int64)
        counts = dict(zip(*np.unique(sizes, return_counts=True), strict=True)) if n else {}
        plan = plan_packing({int(k): int(v) for k, v in counts.items()}, capacity)
        number = np.array([int((sizes[:k] == s).sum()) for k, s in enumerate(sizes)], np.int64)
        if not n:
            assert plan.sequences == 0
            continue
        sequence, offset = plan.place(sizes, number)
        rows = [type("R", (), {"sequence_id": int(a), "offset": int(b), "length": int(s)}) for a, b, s in zip(sequence, offset, sizes, strict=True)]
        assert check(rows, capacity) == plan.sequences
        # no worse than first fit decreasing is known to be, and near the least possible
        assert plan.sequences <= 11 / 9 * -(-int(sizes.sum()) // capacity) + max(4, (2 * sizes > capacity).sum())


def test_large_pieces_pair_greedily():
    groups = match_large({60: 2, 55: 1, 40: 3, 35: 1}, 100)
    assert sorted((sorted(s for s, k in g for _ in range(k)), n) for g, n in groups) == [([35], 1), ([40, 55], 1), ([40, 60], 2)]


def test_cut():
    assert cut(5, 10) == [(0, 5)] and cut(10, 10) == [(0, 10)] and cut(23, 10) == [(0, 3), (3, 13), (13, 23)]


def test_round_trip(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, *(prose(k, 5 + 40 * k) for k in range(60)), prose(1, 9000), prose(1, 45), prose(1, 45)]
    rows = pack(documents(spark, texts).repartition(3), capacity=256).collect()
    check(rows, 256)
    for k, t in enumerate(texts):
        pieces = sorted((r.piece, r.start, r.length, list(r.tokens)) for r in rows if r.doc_id == k)
        want = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert [p for p, *_ in pieces] == list(range(len(pieces))) and [x for *_, ids in pieces for x in ids] == want
        assert all(n == 256 for _, _, n, _ in pieces[1:]) and all(start == sum(x[2] for x in pieces[:p]) for p, start, _, _ in pieces)
    assert pack(documents(spark, ["x"]).limit(0)).count() == 0


def test_query(spark):
    rows = query(spark, "/root/testdata/sf0.001").collect()
    used = check(rows, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 2
    library, first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id = 4").first()
    ids = np.array([*library.encode(first.text, add_special_tokens=False).ids, 0], "<u4")
    assert [r.ids_crc32 for r in rows if r.doc_id == 4] == [zlib.crc32(ids.tobytes())]
