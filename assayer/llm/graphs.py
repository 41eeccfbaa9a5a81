"""Connected components of a graph held in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm import tables


def components(edges: DataFrame, scratch: tables.Scratch) -> DataFrame:
    """node, label (the smallest node of its component) for edges (a, b): labels hop over edges and then over labels, so rounds grow with the logarithm of a path's length.

    Each round joins and takes minima, with partial sums before the shuffle; no
    node's neighbours are gathered anywhere.
    """
    both = scratch.written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct(), "edges")
    labels = scratch.written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        label = F.least("label", "up")
        labels = scratch.written(own.join(up, "label").select("node", label.alias("label"), (label != F.col("old")).alias("moved")), "labels")
    return labels.select("node", "label")
