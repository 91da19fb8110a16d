"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that links from ``a`` to ``b`` reach, for every node with a link.

    Each round lowers a node's label to the least among its neighbours' and then to its label's label; the
    number of rounds grows with the logarithm of the longest path. Labels are written after each round."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("least"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("component", "least").alias("to"), "component")
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = written(lower.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("component"), F.col("component").alias("was")))
        labels = new.select("node", "component")
        if new.filter(F.col("component") < F.col("was")).isEmpty():
            return labels
