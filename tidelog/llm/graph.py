"""Connected components by label propagation with pointer jumping, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the undirected ``edges`` (a, b); label is the component's smallest node.

    Each round every node takes the smallest label among its own, its
    neighbours' and its label's, so a path of length n needs about log n rounds.
    """
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("label").alias("top"))
        new = cut(step.join(up, "mid").select("node", "old", F.least("mid", "top").alias("label")))
        changed = new.where("label <> old").limit(1).count()
        drop_cut(labels)
        labels = new
        if not changed:
            drop_cut(both)
            return labels.select("node", "label")
