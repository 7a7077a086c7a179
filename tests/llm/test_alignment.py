from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from llm.helpers import ODD, documents, prose
from tokenizers import Tokenizer

from loomshed.llm.alignment import Aligned, align, query, side

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(A))
LIBRARY.encode_special_tokens = True
PIECES = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_OF = {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in SHOWN)}
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def whole(text):
    """(id, bytes) of both sides by the libraries; nothing where the bytes differ."""
    if not text:
        return [], []
    one = [(i, bytes(BYTE_OF[c] for c in LIBRARY.id_to_token(i))) for i in LIBRARY.encode(" " + text, add_special_tokens=False).ids]
    other = []
    for i in PIECES.encode(text):
        p = PIECES.id_to_piece(i)
        other.append((i, bytes([int(p[3:5], 16)]) if PIECES.is_byte(i) else p.replace("▁", " ").encode()))
    spelled = b" " + text.encode()
    return (one, other) if all(b"".join(w for _, w in x) == spelled for x in (one, other)) else ([], [])


def brute(rows):
    """Rows as align gives them, by intervals: every pair of tokens is tried while it can overlap."""
    found, documents_of = [], Counter()
    for _, text in rows:
        spans = []
        for tokens in whole(text):
            at, out = 0, []
            for i, w in tokens:
                out.append((i, at, at + len(w)))
                at += len(w)
            spans.append(out)
        links, k = [], 0
        for i, s, e in spans[0]:
            while k < len(spans[1]) and spans[1][k][2] <= s:
                k += 1
            m = k
            while m < len(spans[1]) and spans[1][m][1] < e:
                links.append((i, spans[1][m][0]))
                m += 1
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        said = ";".join("|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in spans) for lo, hi in zip([0, *cuts], cuts, strict=False)) if len(cuts) < 400 else None
        found.append((len(spans[0]), len(spans[1]), len(cuts), links, said))
        documents_of.update(set(links))
    most = Counter()
    for (a, _), n in documents_of.items():
        most[a] = max(most[a], n)
    return [(i, na, nb, g, len(x), sum(documents_of[p] == most[p[0]] for p in x), sum(documents_of[p] for p in x), said if not said else hashlib.sha256(said.encode()).hexdigest()) for (i, _), (na, nb, g, x, said) in zip(rows, found, strict=True)]


def awkward(seed: int, n: int) -> str:
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<s>", "<0x41>", "<unk>", " ", "   ", "\n\n", "\t", "don't", "'re", "12345", "漢字", "é", "🙂", "z" * 40, "...", "word", " Word", "\xa0", "\r\n", "▁", "ſ", "\x00", "½", "ﬁ"]
    return "".join(rng.choice(parts) for _ in range(n))


def awkward_common(seed: int, n: int) -> str:
    """Of characters that take the fast path."""
    rng = random.Random(seed)
    parts = ["<|endoftext|>", "<s>", "<0x41>", " ", "  ", "     ", "\n", "\n\n", "\t", "don't", "'re", "12345", "é", "z" * 40, "...", "word", " Word", "\r\n", "\x00", "Über"]
    return "".join(rng.choice(parts) for _ in range(n))


def same(df, rows):
    got = sorted(tuple(r) for r in df.select(*COLUMNS).collect())
    want = sorted(brute(rows), key=lambda r: r[:7])
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:7] == w[:7] and (w[7] is None or g[7] == w[7])


@pytest.mark.parametrize("most_pairs", [1 << 21, 40, 1])
def test_equals_brute_force(spark, most_pairs):
    """Also where few pairs are sent and most are joined; repeated rows count each."""
    texts = [*ODD, *(awkward(s, 60) for s in range(12)), *(awkward_common(s, 80) for s in range(20)), prose(1, 200), prose(1, 200), "<|endoftext|>", "<s> </s>", " ", "a", prose(2, 20000), "y" * 30000]
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, "a b"), (3, "a b"), (3, "other")]
    same(align(documents(spark, rows).withColumnRenamed("lang", "n_links").withColumnRenamed("source", "pair"), most_pairs=most_pairs), rows)


def test_both_fast_paths_agree_on_every_character_they_take():
    for c in map(chr, range(0x300)):
        text = f"a{c}b {c}1{c}{c} {c}\n{c}c'{c}ll.{c} "
        one, other = whole(text)
        assert side(A).ids(text) == (LIBRARY.encode(" " + text, add_special_tokens=False).ids), hex(ord(c))
        assert side(B).ids(text) == ([i for i, _ in other] if one else []), hex(ord(c))


def test_cut_texts_equal_whole_ones():
    for s in range(60):
        t = awkward_common(s, 300)
        assert side(B).ids(t) == PIECES.encode(t) and side(A).ids(t) == LIBRARY.encode(" " + t, add_special_tokens=False).ids


def test_batches_do_not_touch_each_other():
    texts = [prose(k, 50) if k % 3 else "" for k in range(30)]
    together, apart = Aligned(texts, A, B), [Aligned([t], A, B) for t in texts]
    for k, x in enumerate(apart):
        assert (together.n_a[k], together.n_b[k], together.n_groups[k], together.n_links[k], together.digests[k]) == (x.n_a[0], x.n_b[0], x.n_groups[0], x.n_links[0], x.digests[0])


def test_empty_tables(spark):
    assert align(documents(spark, ["x"]).limit(0)).count() == 0
    assert [tuple(r)[1:] for r in align(documents(spark, [None, ""])).select(*COLUMNS).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    same(query(spark, "/root/testdata/sf0.001"), rows)
