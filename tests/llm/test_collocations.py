from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest
from llm.helpers import ODD, documents

from loomshed.llm.collocations import mine, phrases_of, query
from loomshed.llm.common import Scratch
from loomshed.llm.queries import ORACLES

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counts(rows, longest=4):
    """{lang: Counter of word tuples}."""
    found = {}
    for lang, text in rows:
        f = found.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            f.update(tuple(w[k : k + d]) for d in range(1, longest + 1) for k in range(len(w) - d + 1))
    return found


def brute(rows, longest=4, least=30, top=2000, cover=80):
    out = []
    for lang, f in counts(rows, longest).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            inside = (q for q in candidates if len(q) > len(p) and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)))
            if any(100 * candidates[q] >= cover * a for q in inside):
                continue
            score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, left, right, n, -s) for k, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def corpus(seed: int, n: int) -> list[tuple[str | None, str | None]]:
    """Texts of few words, so that phrases of all lengths repeat; some phrases stand mostly inside longer ones."""
    rng = random.Random(seed)
    fixed = ["new york city hall", "Red Panda", "a b a b", "é ü 漢", "one two three", "x\x01 y", "x y", "tab\there"]
    words, out = [f"w{k}" for k in range(12)], []
    for _ in range(n):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(1, 40))]
        out.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ", ", "!"]) for p in parts)))
    return out


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, 1, "x") for k, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, a int, phrase string")


@pytest.mark.parametrize(("shard_words", "options"), [(1 << 21, {}), (150, {}), (150, {"longest": 2}), (400, {"least": 3, "top": 7}), (1 << 21, {"least": 1, "cover": 100, "longest": 5})])
def test_equals_brute_force(spark, shard_words, options):
    """Whatever the shards; columns with names of ours; repeated rows count each."""
    rows = corpus(1, 120) + corpus(1, 120) + [("en", t) for t in ODD] + [("en", "same same same same " * 30)]
    assert rows_of(mine(table(spark, rows), shard_words=shard_words, **options)) == brute(rows, **options)


def test_parts_come_from_the_tries(spark):
    """Counts of every left and right part, as a trie walk and the suffix links give them."""
    rows = corpus(2, 150)
    found, words = phrases_of(table(spark, rows), 4, 30, Scratch(spark, "test"), 200)
    f = counts(rows)
    got = {(r.lang, tuple(r.phrase.split(" "))): (r.a, r.lefts, r.rights) for r in found.collect()}
    want = {(lang, p): (a, [c[p[:k]] for k in range(1, len(p))], [c[p[k:]] for k in range(1, len(p))]) for lang, c in f.items() for p, a in c.items() if len(p) > 1 and a >= 30}
    assert got == want and max(len(p) for _, p in got) == 4
    assert {r.lang: r.n for r in words.collect()} == {lang: sum(a for p, a in c.items() if len(p) == 1) for lang, c in f.items()}


def test_hot_parents_are_dealt_out(spark, monkeypatch):
    from loomshed.llm import collocations

    monkeypatch.setattr(collocations, "SPLIT", 50)
    rows = corpus(3, 200)
    assert rows_of(mine(table(spark, rows), shard_words=300)) == brute(rows)


def test_products_beyond_64_bits(spark):
    """Scores and covers are exact for counts whose products pass 64 bits."""
    big = 7 * 10**14
    df = spark.createDataFrame([(big, [big + 1], [3 * big + 2])], "a bigint, lefts array<bigint>, rights array<bigint>")
    score = "(2000000bd * a) div (cast(lefts[0] as decimal(20,0)) + rights[0])"
    assert df.selectExpr(f"{score} as s").first().s == 2_000_000 * big // (4 * big + 3)


def test_empty_tables(spark):
    assert mine(documents(spark, ["x"]).limit(0)).count() == 0
    assert mine(documents(spark, [None, "", " . "])).count() == 0


def test_long_text(spark):
    rows = [("en", " ".join(f"w{(k * k) % 97}" for k in range(60_000)) + " " + "z" * 100_000)]
    assert rows_of(mine(table(spark, rows))) == brute(rows)


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    got = rows_of(query(spark, folder))
    want = sorted(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op12_collocations']})").fetchall())
    assert got == want and len(got) > 100
    assert got == brute([(r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()])
