"""Connected components of a link table, in DataFrame operations alone.

Each node takes the smallest label among its neighbours, then the label of its label (pointer jumping), until
nothing changes. A star settles in one round, a path of n nodes in about log n. Every round is written to the
shared folder, and only a count comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, work: Scratch, name: str = "components") -> DataFrame:
    """(node, component) of every node that occurs in links (a, b); component is the smallest node. Self links do no harm."""
    pairs = links.select("a", "b")
    edges = work.save(pairs.union(pairs.select("b", "a")).distinct().toDF("u", "v"), f"{name}_edges")
    # the label's change is counted against the round before, so each round needs one pass
    labels = work.save(edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("component")).select(F.col("u").alias("node"), "component"), f"{name}_0")
    turn = 0
    while True:
        nearby = edges.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        lower = labels.join(nearby, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("c"))
        lower = work.save(lower, f"{name}_low{turn}")
        jump = lower.select(F.col("node").alias("c"), F.col("c").alias("component"))
        turn += 1
        labels = work.save(lower.join(jump, "c").select("node", "component", (F.col("component") != F.col("was")).alias("changed")), f"{name}_{turn}")
        done = labels.where("changed").isEmpty()
        work.drop(f"{name}_low{turn - 1}", f"{name}_{turn - 1}")
        if done:
            work.drop(f"{name}_edges")
            return labels.select("node", "component")
