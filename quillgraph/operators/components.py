"""Connected components of a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.stored import stored


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of ``links`` (a, b): the smallest node of its component.

    A round hooks every label to the smallest label next to it and then halves the way to the root
    (label of the label), so rounds grow with the logarithm of the widest component, about. All joins are on one key of
    fixed-size rows and merge sorted sides, so that nothing passes through the driver; a hub's links are grouped with partial minima before they move.
    """
    links = links.filter("a <> b").select("a", "b")
    ways = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        around = ways.join(labels.select(F.col("node").alias("b"), F.col("label").alias("seen")).hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("seen").alias("seen"))
        hooked = labels.join(around.hint("merge"), "node").select("node", "label", F.least("label", "seen").alias("near"))
        roots = labels.select(F.col("node").alias("near"), F.col("label").alias("root"))
        after = stored(hooked.join(roots.hint("merge"), "near").select("node", F.least("near", "root").alias("label"), (F.least("near", "root") != F.col("label")).alias("moved")))
        if after.filter("moved").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
