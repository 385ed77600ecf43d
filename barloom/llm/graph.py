"""Connected components by iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Each round gives a node the smallest label among its neighbours and itself (combined on the map side, so a node
    with very many links is no hot key of the aggregation), then replaces the label by that label's own label, which
    halves the distance left. Rounds end when no label changed. Null ends and self links are ignored; no edges give
    an empty table.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = scratch.keep(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}_both")
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                          .select("node", F.least("node", "m").alias("component")), f"{tag}_0")
    step = 0
    while True:
        step += 1
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node", "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("heard", "component")).alias("near"))
        over = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = scratch.keep(near.join(over, "near", "left").select(
            "node", "old", F.least("near", F.coalesce("far", "near")).alias("component")), f"{tag}_{step}")
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
