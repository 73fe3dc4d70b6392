"""Connected components as DataFrame rounds: no link reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the component's smallest node.

    Each round takes the smallest label around a node, then the label of that label; rounds end
    when no label changes. Rounds grow with the logarithm of the longest path, about.
    """
    both = materialize(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")).hint("merge"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("other").alias("other"))
        )
        stepped = labels.join(near.hint("merge"), "node").select("node", "label", F.least("label", "other").alias("nearer"))
        jump = labels.select(F.col("node").alias("nearer"), F.col("label").alias("far"))
        joined = stepped.join(jump.hint("merge"), "nearer").select(
            "node", F.least("nearer", "far").alias("label"), (F.least("nearer", "far") != F.col("label")).alias("moved")
        )
        after = materialize(joined, "labels")
        if after.filter("moved").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
