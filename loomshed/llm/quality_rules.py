"""Quality rules whose cutoffs are chosen under a proven limit of false rejections.

Base rules are fixed. The others reject a document if a statistic reaches its stratum's cutoff. The labelled rows are
split by a hash. One part proposes, for each stratum, a sequence of sets of cutoffs from mild to strict: at each level a rule's
cutoff is the best of those that cost the part at most so many good documents. The other part, the holdout, tests the sets in
this order: the hypothesis "all rules of this set together reject more than `alpha` of the stratum's good documents" is
tested with the exact binomial distribution, and testing stops at the first that can't be rejected. A sequence in a fixed order
needs no correction within itself; across strata the level is divided (Bonferroni). So with probability 1 - delta no stratum
loses more than alpha of its good documents to all the rules together.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import lgamma, log, log1p

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, held_out_col
from .stats import COLUMNS, agreed_labels, with_stats

#: Each rule's statistic (the higher, the worse) over the columns of stats.
RULES = {
    "symbols": "n_symbols / n_words", "repeats": "n_repeat_words / n_words", "dup_lines": "n_dup_lines / greatest(n_lines, 1)", "upper": "n_upper / greatest(n_letters, 1)", "marks": "n_marks / n_words",
    "digits": "n_digits / n_words", "top_word": "n_top / n_words", "few_pairs": "1 - n_unique_pairs / n_words", "long_words": "word_chars / n_words / 100", "short": "10 / n_words",
}
#: The cutoffs of the grid, strictest last: as shares of the statistic's range from 0 to 2.
GRID = tuple(2 * 0.93**k for k in range(90))


#: Shares of the proposing part's good documents that a single rule may cost, level by level.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.004, 0.008, 0.016)
#: One labelled row in so many proposes; the others test.
PROPOSING = 3


@dataclass(frozen=True)
class Risk:
    """alpha: most good documents that all rules together may cost a stratum; delta: chance that any such limit fails."""

    alpha: float = 0.01
    delta: float = 0.05
    #: Among the cutoffs proposed, a lost good document weighs as much as so many caught bad ones.
    price: float = 10

    def least(self, strata: int) -> int:
        """Good documents without which a stratum can't pass any test."""
        return int(np.ceil(log(self.delta / max(1, strata)) / log1p(-self.alpha)))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed in logs."""
    if k >= n:
        return 1.0
    terms = [lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * log(p) + (n - i) * log1p(-p) for i in range(k + 1)]
    most = max(terms)
    return min(1.0, float(np.exp(most) * np.exp(np.array(terms) - most).sum()))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def statistic(rule: str) -> Column:
    """Of documents with words; those without fail the base rules anyway."""
    return F.when(F.col("n_words") > 0, F.expr(RULES[rule])).otherwise(F.lit(0.0))


def step(rule: str) -> Column:
    """The first cutoff of the grid that the statistic reaches; len(GRID) if none."""
    k = F.ceil(F.log(statistic(rule) / GRID[0]) / F.log(F.lit(GRID[1] / GRID[0])) - 1e-9)
    return F.when(statistic(rule) <= 0, len(GRID)).otherwise(F.least(F.greatest(k, F.lit(0)), F.lit(len(GRID)))).cast("int")


def propose(counts: np.ndarray, price: float) -> list[int]:
    """A rule's cutoff (a step, -1 for none) at each level; counts: rows [good, bad] by grid step. Never milder at a later level."""
    lost, caught = np.cumsum(counts[0])[:-1], np.cumsum(counts[1])[:-1]
    worth, out = caught - price * lost, []
    for share in LEVELS:
        allowed = np.flatnonzero((lost <= share * counts[0].sum()) & (worth > 0))
        best = int(allowed[np.argmax(worth[allowed])]) if allowed.size else -1  # the mildest of those that are worth as much
        out.append(max([best, *out[-1:]]))
    return out


def proven_level(first: np.ndarray, risk: Risk, strata: int) -> int:
    """The last level in a row whose joint loss is proven to be at most alpha; -1 if none. first: the holdout's good documents by the first level that rejects them, at last those that none does."""
    n, lost = int(first.sum()), np.cumsum(first)
    for k in range(len(LEVELS)):
        if lost[k] > risk.alpha * n or binomial_cdf(int(lost[k]), n, risk.alpha) > risk.delta / max(1, strata):
            return k - 1
    return len(LEVELS) - 1


def first_level(cutoffs: str) -> Column:
    """The first level whose cutoffs (an array of each rule's cutoffs by level) reject the document; len(LEVELS) if none."""
    of_rule = lambda k, rule: F.size(F.filter(F.get(cutoffs, F.lit(k)), lambda c: c < step(rule)))
    return F.coalesce(F.least(*(of_rule(k, r) for k, r in enumerate(RULES))), F.lit(len(LEVELS)))


def proposed(good_and_bad: DataFrame, strata: list[str | None], risk: Risk) -> dict[str | None, list[list[int]]]:
    """Of each stratum the cutoffs by rule and level, from the proposing part's steps; no other stratum's are counted."""
    wanted = by_stratum(good_and_bad, dict.fromkeys(strata, True), "boolean", "wanted").where("wanted")
    tall = wanted.select("__stratum", "label", F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), step(r).alias("step")) for r in RULES))).alias("x"))
    counts = {(s, r): np.zeros((2, len(GRID) + 1), np.int64) for s in strata for r in RULES}
    for r in tall.groupBy("__stratum", "x.rule", "label", "x.step").count().collect():
        counts[r["__stratum"], r["rule"]][1 - r["label"], r["step"]] += r["count"]
    return {s: [propose(counts[s, r], risk.price) for r in RULES] for s in strata}


def by_stratum(df: DataFrame, rows: dict, kind: str, name: str) -> DataFrame:
    """df with the column `name`: what `rows` has for each row's stratum; null if nothing. There are at most as many strata as can pass a test."""
    table = df.sparkSession.createDataFrame([(s, x) for s, x in rows.items()], f"__key string, {name} {kind}")
    return df.join(F.broadcast(table), F.col("__stratum").eqNullSafe(F.col("__key")), "left").drop("__key")


def judge_quality(docs: DataFrame, labels: DataFrame, risk: Risk | None = None, stratum: str = "lang", keep: tuple[str, ...] = ("doc_id",), work: Scratch | None = None) -> DataFrame:
    """One row per document: `keep` (with doc_id), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null texts have no words and fail. A null stratum is one of its own. A stratum with too few labelled good
    documents for any test keeps what the base rules keep. Without labels only the base rules hold. Repeated rows
    stay; other columns are ignored.
    """
    risk, work = risk or Risk(), work or Scratch(docs.sparkSession, "rules")
    stats = work.save(with_stats(docs.select(*keep, F.col(stratum).cast("string").alias("__stratum"), F.col("text").alias("__whole")), (*keep, "__stratum"), "__whole").withColumn("base_failed", base_failed()), "stats")
    judged = stats.where("not base_failed").join(agreed_labels(labels, "quality"), "doc_id")
    judged = work.save(judged.select("__stratum", "label", held_out_col("doc_id", PROPOSING, 0).alias("proposes"), *COLUMNS), "judged")
    good = {r["__stratum"]: r["count"] for r in judged.where("label = 1 and not proposes").groupBy("__stratum").count().where(F.col("count") >= risk.least(1)).collect()}
    strata = [s for s, n in good.items() if n >= risk.least(len(good))]
    cutoffs = proposed(judged.where("proposes"), strata, risk)
    levels = by_stratum(judged.where("label = 1 and not proposes"), cutoffs, "array<array<int>>", "cutoffs").where("cutoffs is not null").withColumn("first", first_level("cutoffs"))
    first = {s: np.zeros(len(LEVELS) + 1, np.int64) for s in strata}
    for r in levels.groupBy("__stratum", "first").count().collect():
        first[r["__stratum"]][r["first"]] = r["count"]
    chosen = {s: k for s in strata if (k := proven_level(first[s], risk, len(strata))) >= 0}
    work.drop("judged")
    final = by_stratum(stats, {s: [of_rule[k] for of_rule in cutoffs[s]] for s, k in chosen.items()}, "array<int>", "cutoffs")
    failed = [step(r) <= F.coalesce(F.get("cutoffs", F.lit(k)), F.lit(-1)) for k, r in enumerate(RULES)]
    kept = ~F.col("base_failed") & ~reduce(lambda a, b: a | b, failed)
    return final.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's counts and verdict."""
    return judge_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
