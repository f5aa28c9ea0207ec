"""Connected components by label propagation with pointer jumping, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.store import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge: the smallest node reachable.

    Each round takes the smallest label of all neighbours, then the label of the label, so
    long chains shorten fast; it ends when no label changed. Labels are written down each
    round, so a lost executor repeats one round at most.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
    both = both.unionByName(both.select(F.col("next").alias("node"), F.col("node").alias("next"))).distinct()
    both = written(both, "edges")
    labels = both.groupBy("node").agg(F.least(F.col("node"), F.min("next")).alias("component"))
    labels = written(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("next"), F.col("component").alias("seen")), "next")
        least = near.groupBy("node").agg(F.min("seen").alias("seen"))
        moved = labels.join(least, "node").select(
            "node", "component", F.least("component", "seen").alias("lower")
        )
        hop = labels.select(F.col("node").alias("lower"), F.col("component").alias("over"))
        fresh = written(
            moved.join(hop, "lower").select("node", F.col("component").alias("old"), F.least("lower", "over").alias("component")),
            "labels",
        )
        changed = fresh.filter("old <> component").limit(1).count()
        labels = fresh.drop("old")
        if not changed:
            return labels
