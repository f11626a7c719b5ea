"""Connected components over edge tables of any size, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of ``edges``; a component is named by its smallest node.

    Each round takes the smallest label among a node's neighbours, then the label of that label (pointer jumping), so
    stars end in two rounds and chains in about the logarithm of their length.  Hubs are met by partial aggregation
    and by joins of written tables, which adaptive execution splits.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = cut(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = cut(both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("least"))
        step = cut(labels.join(near, "node").select("node", F.least("component", "least").alias("next"), F.col("component").alias("was")), "labels")
        up = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        labels = cut(step.join(up, "next").select("node", F.least("next", "up").alias("component"), "was"), "labels")
        discard(step)
        if not labels.where("component <> was").limit(1).count():
            return labels.select("node", "component")
        labels = labels.select("node", "component")
