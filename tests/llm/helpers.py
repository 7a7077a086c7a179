"""Small tables for the operators' tests, and brute-force versions of what they compute."""

from __future__ import annotations

import random

SPACES = " \t\n\x0b\x0c\r"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, **more):
    """Rows (doc_id, text) or texts alone, with the other columns of documents."""
    rows = [t if isinstance(t, tuple) else (k, t) for k, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, more.get("lang", "en"), more.get("source", f"s{(i or 0) % 3}"), None if t is None else len(t)) for i, t in rows], DOCS)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    """n invented words in lines and sentences."""
    rng = random.Random(seed)
    words = [f"w{rng.randrange(vocabulary)}" for _ in range(n)]
    return "".join(w + (".\n" if k % 12 == 11 else " ") for k, w in enumerate(words)).strip()


def mutated(text: str, seed: int, n: int) -> str:
    """n words replaced."""
    rng, words = random.Random(seed), text.split(" ")
    for k in rng.sample(range(len(words)), n):
        words[k] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


#: Texts that no operator may stumble over.
ODD = [None, "", " ", "\n\n\n", "word", "a b", "\x00\x07 é ü 漢字 🙂  x y", "same same same " * 50, "z" * 5000, "- - - - - -", "Ab\tCd\r\nEf\x0bGh\x0cIj"]


def components(pairs, nodes):
    """Smallest node of each node's component."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
