"""Quality rules and classifier."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from llm.helpers import ODD, documents, prose

from loomshed.llm import quality_classifier, quality_rules
from loomshed.llm.quality_classifier import fit, forward, score_quality
from loomshed.llm.quality_rules import GRID, LEVELS, Risk, binomial_cdf, judge_quality, propose, proven_level
from loomshed.llm.stats import COLUMNS, repeat_words, text_stats

LABELS = "doc_id bigint, quality int, toxic int"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    many = {w for w, n in Counter(windows).items() if n > 1}
    inside = {k + j for k, w in enumerate(windows) if w in many for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def junk(seed: int, n: int) -> str:
    return " ".join(f"{w}%%% | ###" for w in prose(seed, n).split())


def corpus(n: int = 1500):
    """Two thirds good prose, one third junk; labels for most."""
    texts = [prose(k, 30 + k % 90) if k % 3 else junk(k, 20 + k % 40) for k in range(n)]
    return texts, [(k, int(k % 3 > 0), 0) for k in range(n) if k % 10]


def test_counts(spark):
    texts = [*ODD, prose(1, 40) + "\n" + prose(1, 40), "a b c d e f a b c d e", "x\ny\nx\n \nx", "1 2 3 4 5 6 " * 30, "café # | < >\n\n\x0b"]
    got = {r.doc_id: r for r in judge_quality(documents(spark, texts).withColumnRenamed("source", "n_words"), spark.createDataFrame([], LABELS)).collect()}
    for k, t in enumerate(texts):
        want = brute_counts(t)
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)
    assert repeat_words([b"a"] * 6) == 6 and repeat_words([b"a"] * 5) == 0


@pytest.mark.parametrize(("n", "p"), [(1, 0.5), (20, 0.1), (300, 0.01)])
def test_binomial(n, p):
    for k in range(-1, min(n, 12) + 1):
        exact = sum(comb(n, i) * Fraction(p) ** i * (1 - Fraction(p)) ** (n - i) for i in range(k + 1))
        assert abs(binomial_cdf(k, n, p) - float(exact)) < 1e-9 if k >= 0 else True


def test_a_stratum_keeps_its_limit():
    """Over many holdouts of one population, all rules together lose more than alpha hardly ever, and the proof is not in vain."""
    rng, risk, wrong, proven = np.random.default_rng(0), Risk(0.02, 0.05), 0, 0
    loss = np.array([0.004, 0.003, 0.006, 0.006, 0.005, 0.01, 0.02])  # of each level beyond the one before: the limit is crossed at the fifth
    for _ in range(2000):
        first = rng.multinomial(900, [*loss, 1 - loss.sum()])
        k = proven_level(first, risk, 1)
        wrong += k >= 0 and loss[: k + 1].sum() > risk.alpha
        proven += k >= 0
    assert wrong / 2000 <= risk.delta and proven > 1500


def test_levels_grow_stricter_and_need_evidence():
    rng = np.random.default_rng(2)
    counts = np.stack([np.bincount(np.clip(rng.normal(70, 12, 4000), 0, len(GRID)).astype(int), minlength=len(GRID) + 1), np.bincount(np.clip(rng.normal(30, 12, 900), 0, len(GRID)).astype(int), minlength=len(GRID) + 1)])
    cuts = propose(counts, 1)
    lost = np.cumsum(counts[0])
    assert cuts == sorted(cuts) and cuts[-1] > cuts[0] >= 0 and all(lost[c] <= share * 4000 for c, share in zip(cuts, LEVELS, strict=True))
    assert propose(np.zeros((2, len(GRID) + 1), int), 10) == [-1] * len(LEVELS)
    few = np.zeros(len(LEVELS) + 1, int)
    few[-1] = Risk().least(1) - 1
    assert proven_level(few, Risk(), 1) == -1 and proven_level(few + (few > 0), Risk(), 1) == len(LEVELS) - 1


def judged_brute(rows, labels, risk):
    """doc_id -> kept, from the definitions: rows (doc_id, text, lang), agreed labels by doc_id."""
    ratio = lambda k: GRID[0] * (GRID[1] / GRID[0]) ** k
    steps, passed = {}, {}
    for i, t, lang in rows:
        x = dict(zip(COLUMNS, text_stats(t or ""), strict=True))
        n = x["n_words"]
        passed[i] = n >= 10 and 100 * x["n_repeat_words"] <= 20 * n
        values = n and [x["n_symbols"] / n, x["n_repeat_words"] / n, x["n_dup_lines"] / max(1, x["n_lines"]), x["n_upper"] / max(1, x["n_letters"]), x["n_marks"] / n, x["n_digits"] / n, x["n_top"] / n, 1 - x["n_unique_pairs"] / n, x["word_chars"] / n / 100, 10 / n]
        steps[i] = [next((k for k in range(len(GRID)) if v >= ratio(k) * (1 - 1e-9)), len(GRID)) for v in values or [0] * 10]
    kept = dict(passed)
    of = lambda lang, part, y: [i for i, _, l in rows if l == lang and passed[i] and labels.get(i) == y and (zlib.crc32(str(i).encode()) % 3 == 0) == part]  # noqa: E731, E741
    able = [s for s in {l for _, _, l in rows} if len(of(s, False, 1)) >= risk.least(1)]  # noqa: E741
    strata = [s for s in able if len(of(s, False, 1)) >= risk.least(len(able))]
    for s in strata:
        good, bad, held = of(s, True, 1), of(s, True, 0), of(s, False, 1)
        level, before = [], [-1] * 10
        for share in LEVELS:
            for r in range(10):
                best, worth = -1, 0
                for k in range(len(GRID)):
                    lost, caught = sum(steps[i][r] <= k for i in good), sum(steps[i][r] <= k for i in bad)
                    if lost <= share * len(good) and caught - risk.price * lost > worth:
                        best, worth = k, caught - risk.price * lost
                before[r] = max(before[r], best)
            level.append(list(before))
        chosen = None
        for cuts in level:
            lost = sum(any(a <= c for a, c in zip(steps[i], cuts, strict=True)) for i in held)
            if binomial_cdf(lost, len(held), risk.alpha) > risk.delta / len(strata) or lost > risk.alpha * len(held):
                break
            chosen = cuts
        for i, _, l in rows:  # noqa: E741
            if chosen and l == s and any(a <= c for a, c in zip(steps[i], chosen, strict=True)):
                kept[i] = False
    return kept


def test_kept_equals_brute_force(spark):
    """Three languages, one of them null and one with too few labels, over texts of all kinds."""
    rng, rows, labels = random.Random(8), [], []
    for k in range(700):
        text = prose(k, 15 + k % 70) if k % 3 else junk(k, 12 + k % 30) if k % 2 else prose(k, 40, 9)
        if k % 50 == 1:
            text += " ##"
        lang = None if k % 5 == 0 else "xx" if k % 17 == 0 else "en"
        rows.append((k, text, lang))
        if rng.random() < 0.85:
            labels.append((k, int(k % 3 > 0) if rng.random() < 0.97 else 0, 0))
    rows += [(1000 + k, t, "en") for k, t in enumerate(ODD)] + [(2000, "word " * 20000, "en"), (2001, prose(3, 30000, 10**6), None)]
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, t, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    risk = Risk(0.03, 0.1)
    got = {r.doc_id: r.kept for r in judge_quality(docs, spark.createDataFrame(labels, LABELS), risk).collect()}
    want = judged_brute(rows, {i: q for i, q, _ in labels}, risk)
    assert got == want and any(not got[i] for i, t, _ in rows if i < 700 and not i % 3)


def test_rules_catch_junk_and_leave_prose(spark):
    texts, labels = corpus()
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in judge_quality(docs, spark.createDataFrame(labels + [(None, 1, 0), (2, None, 0)], LABELS), Risk(0.03, 0.1)).collect()}
    good = [k for k in range(len(texts)) if k % 3]
    assert sum(not got[k].kept for k in good) <= 0.03 * len(good)
    assert sum(got[k].kept for k in range(0, len(texts), 3)) <= 0.05 * len(texts) / 3
    assert judge_quality(docs.limit(0), spark.createDataFrame(labels, LABELS)).count() == 0


def test_discriminant_is_the_ratio_of_the_densities():
    rng = np.random.default_rng(1)
    x = {0: rng.normal(0, 1, (400, 3)), 1: rng.normal(1, [0.5, 1, 2], (300, 3))}
    model = fit({k: (len(v), v.sum(0), v.T @ v) for k, v in x.items()}, 0.2, 0.05)
    at = rng.normal(0.5, 1, (50, 3))
    pooled = sum((len(v) * np.cov(v.T, bias=True)) for v in x.values()) / 700
    s = np.sqrt(np.diag(pooled))
    log = []
    for k, v in x.items():
        c = (0.8 * np.cov(v.T, bias=True) + 0.2 * pooled) / np.outer(s, s)
        c = 0.95 * c + 0.05 * np.trace(c) / 3 * np.eye(3)
        d = (at - v.mean(0)) / s
        log.append(np.log(len(v) / 700) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (d @ np.linalg.inv(c) * d).sum(1))
    assert np.allclose(model.score(at), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_classifier(spark):
    texts, labels = corpus(900)
    rng = random.Random(3)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    docs = documents(spark, [*texts, *ODD]).union(documents(spark, [(None, "x y"), (5, texts[5])]))
    got = score_quality(docs.withColumnRenamed("lang", "score"), spark.createDataFrame(labels + [(None, 1, 0), (rng.randrange(9), None, 0)], LABELS)).collect()
    assert len(got) == len(texts) + len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum((r.doc_id % 3 > 0) == bool(r.predicted) for r in held) >= 0.98 * len(held)
    # labels of held-out rows change nothing
    again = {r.doc_id: r.score for r in score_quality(docs, spark.createDataFrame(flipped, LABELS)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got if r.doc_id is not None)
    none = score_quality(docs, spark.createDataFrame([], LABELS)).collect()
    assert {r.score for r in none} == {0.5}


def test_queries(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in quality_classifier.query(spark, folder).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.97 * len(rows)
    rules = [r for r in quality_rules.query(spark, folder).collect() if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert sum(r.kept for r in rules) >= 0.98 * len(rules)


def test_scores_equal_brute_force(spark):
    """Densities from each class's covariance as it is defined, over features of whole texts, long ones too."""
    texts, labels = corpus(400)
    texts += [*(t or "" for t in ODD), prose(5, 40_000, 10**5), "word " * 30_000]
    got = {r.doc_id: r.score for r in score_quality(documents(spark, texts), spark.createDataFrame(labels, LABELS)).collect()}
    values = list(zip(*map(text_stats, texts), strict=True))
    x = quality_classifier.transformed({c: np.array(v, float) for c, v in zip(COLUMNS, values, strict=True)})
    of = {k: np.array([i for i, q, _ in labels if q == k and zlib.crc32(str(i).encode()) % 4 != 2]) for k in (0, 1)}
    n = sum(map(len, of.values()))
    cov = {k: np.cov(x[i].T, bias=True) for k, i in of.items()}
    pooled = sum(len(i) * cov[k] for k, i in of.items()) / n
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-6))
    log = []
    for k, i in of.items():
        c = (0.9 * cov[k] + 0.1 * pooled) / np.outer(scale, scale)
        c = 0.98 * c + 0.02 * np.trace(c) / len(c) * np.eye(len(c)) + 1e-9 * np.eye(len(c))
        d = (x - x[i].mean(0)) / scale
        log.append(np.log(len(i) / n) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * (d @ np.linalg.inv(c) * d).sum(1))
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    assert np.allclose([got[k] for k in range(len(texts))], want, atol=1e-6)


def test_forward_solves_a_triangular_system():
    rng = np.random.default_rng(2)
    lower = np.tril(rng.normal(size=(9, 9))) + 5 * np.eye(9)
    b = rng.normal(size=(9, 4))
    assert np.allclose(lower @ forward(lower, b), b)
