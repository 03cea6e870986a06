"""Connected components of an edge table by repeated minimum labels with pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import written

#: Labels are a few bytes per document: so many times fewer files than shuffle partitions.
NARROW = 8


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, label``: for every node of an edge, the smallest node that it reaches.

    Each round hangs every node below the smallest label around it and then halves the
    paths, so rounds grow with the logarithm of the longest path.  Only tables in the shared
    folder carry state between rounds.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    both = written(pairs.union(pairs.select("b", "a")).distinct(), NARROW)
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), NARROW)
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = labels.join(around, labels.node == around.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = lower.select(F.col("node").alias("up"), F.col("label").alias("up_label"))
        new = written(lower.join(up, F.col("label") == F.col("up")).select("node", "old", F.least("label", "up_label").alias("label")), NARROW)
        labels = new.select("node", "label")
        if not new.where("old <> label").take(1):
            return labels


def contracted(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` after further ``links`` ``a, b`` between nodes: only links between components are followed."""
    if labels is None:
        return components(links)
    to = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l_{c}"))
    between = links.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    joined = components(between).withColumnRenamed("label", "to")
    moved = labels.join(joined, labels.label == joined.node, "left").select(labels.node, F.coalesce("to", "label").alias("label"))
    fresh = joined.join(labels.select("node"), "node", "left_anti").select("node", F.col("to").alias("label"))
    return written(moved.unionByName(fresh), NARROW)
