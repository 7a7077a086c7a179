"""Recursion over tables: rounds that join only what the round before has found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: list[str], rounds: int = 1000) -> DataFrame:
    """All rows of `start`, of step(start), of step of what that has found anew, and so on: of each key what was found first.

    A row is new if no earlier round has its key; of rows of one round and key the least is taken. Every round is written down and
    joined by its key alone, so lineage and work stay those of one round. Ends when a round finds nothing, or raises after `rounds`.
    """
    others = [c for c in start.columns if c not in key]
    first = lambda df: df.groupBy(*key).agg(F.min(F.struct(*others)).alias("__r")).select(*key, "__r.*") if others else df.select(*key).distinct()
    found = fresh = written(first(start), "round0")
    parts = [fresh]
    for k in range(1, rounds + 1):
        candidates = first(step(fresh).select(*start.columns))
        same = [candidates[c].eqNullSafe(found[c]) for c in key]
        fresh = written(candidates.join(found.select(*key), same, "left_anti"), f"round{k}")
        if fresh.isEmpty():
            return found
        parts.append(fresh)
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        if len(parts) > 16:  # a plan of few files, whatever the number of rounds
            found = written(found, f"found{k}")
            parts = [found]
    raise ValueError(f"nothing settled within {rounds} rounds")


def hops(edges: DataFrame, seeds: DataFrame, limit: int = 1000) -> DataFrame:
    """node, hops: of every node that the seeds (node) reach over the edges (a, b), the least number of edges. Edges go from a to b."""
    return fixpoint(seeds.select("node", F.lit(0).alias("hops")), lambda new: new.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("hops") + 1).alias("hops")), ["node"], limit)
