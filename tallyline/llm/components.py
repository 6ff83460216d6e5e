"""Connected components of a graph given as a frame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import reliable


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b); label is the component's least node.

    Each round gives every node the least label around it, then the label of its label.
    Both are joins on nodes with map-side combined minimums, so that a node with a third
    of all edges is no task of its own. The number of rounds grows with the logarithm of
    a component's diameter. A round that changes nothing ends it.
    """
    edges = reliable(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = reliable(edges.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("label")
    ))
    while True:
        around = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        above = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = reliable(
            lower.join(above, "label").select("node", F.least("label", "top").alias("label"), (F.col("old") != F.least("label", "top")).alias("changed"))
        )
        labels = jumped.select("node", "label")
        if jumped.where("changed").isEmpty():
            return labels
