"""Connected components of a graph given as edges, by label propagation with pointer jumping; nothing reaches the driver but a flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.session import discard, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of every node that has an edge; label is the smallest node of its component. Nulls and loops are dropped.

    Each round takes the smallest label of a node's neighbours, then that label's own label. A star takes 2 rounds, a chain of n nodes in
    random order about log2 n and in order one or two more; each round is one job over the edges and leaves one small table.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    e = settle(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = settle(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = e.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = settle(step.join(up, "label").select("node", "old", F.least("label", "up").alias("label")))
        discard(labels)
        labels = step
        if step.where("old <> label").isEmpty():
            discard(e)
            return step.select("node", "label")
