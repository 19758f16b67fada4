"""Connected components of large graphs, by turning edges into stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut_lineage


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node of it) for all nodes of edges (a, b), which are numbers.

    Each node's neighbours are hung onto the smallest of them, in turn those above and those below the node, until nothing
    changes; that takes a number of rounds that grows with the logarithm of the graph's size. A round groups with partial
    minima and joins them back, so that no node's neighbours need to be in one place, and is written to the shared folder.
    Edges from a node to itself keep a node that has no others. An empty graph has no components.
    """
    loops = edges.filter("a = b").select(F.col("a").alias("node"))
    now = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        # above: for each node, all larger neighbours go to its smallest neighbour
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.filter("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        # below: for each node, its smaller neighbours and itself go to the smallest of them
        least = up.groupBy("a").agg(F.min("b").alias("m"))
        down = up.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = cut_lineage(down.filter("a <> b").distinct())
        before, state = state, _state(now)
        if before == state:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    ends = now.select(F.col("b").alias("node"), F.col("b").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return nodes.union(ends).union(alone).groupBy("node").agg(F.min("component").alias("component"))
