"""Connected components of an edge table by alternating stars, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import settled


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): the smallest node that a, b edges (longs or binaries) reach. Nodes without edges do not appear.

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest of them; rounds of
    the logarithm of the longest path suffice, and more than `most` raise an error. Minima are pre-aggregated, so a
    hub costs no single task.
    """
    links = edges.select("a", "b").where("a <> b")
    links = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(most):
        # Large star: both directions, larger neighbours go to the least of node and neighbours.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        links = settled(small.where("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components have not settled after {most} rounds")
    tips = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return tips.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
