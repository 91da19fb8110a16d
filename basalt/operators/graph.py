"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.sources.shared import settled


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the least node that edges ``a, b`` reach, for every node with an edge. Ends that are null, and edges
    of a node to itself, join nothing; repeated edges count once; no edges give no rows.

    A round hangs every node's parent below the least parent among its neighbours' and halves the paths; rounds grow with
    the logarithm of the longest path. A node of many edges is met by partial minima only."""
    good = edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = settled(good.unionByName(good.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    found = settled(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")))
    while True:
        near = both.join(found.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("least"))
        lower = found.join(near, "node").select("node", "component", F.least("component", "least").alias("to"))
        roots = lower.groupBy(F.col("component").alias("node")).agg(F.min("to").alias("root"))  # a parent follows what its children have met
        lower = lower.join(roots, "node", "left").select("node", "component", F.least("to", F.coalesce("root", "to")).alias("to"))
        jump = lower.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = settled(lower.join(jump, "to", "left").select("node", F.least("to", F.coalesce("further", "to")).alias("component"), F.col("component").alias("was")))
        found = new.select("node", "component")
        if new.filter("component < was").isEmpty():
            return found
