"""Connected components of links, as joins and minima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewarden.llm.common import checkpointed


def _no_loops(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ordered(node: str) -> Column:
    return F.struct(F.xxhash64(node).alias("hash"), F.col(node).alias("node"))


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (longs ``a, b``); nodes of a component share one root.

    Each round points every node to its first neighbour (or itself) in the order of a hash,
    follows pointers once more, and carries the edges over to where their ends point. Nodes
    never point up that order, and about two thirds of the nodes of a chain point elsewhere,
    so rounds grow with the logarithm of the longest chain, and a star takes two. Minima
    combine within tasks before the shuffle, so a node with many neighbours is no hot spot;
    joins by its key can be split.
    """
    edges = checkpointed(_no_loops(edges))
    roots: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(_ordered("b")).alias("first"))
        near = checkpointed(first.select(F.col("a").alias("node"), F.least("first", _ordered("a"))["node"].alias("up")))
        above = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        points = checkpointed(near.join(above, "up").select("node", "top"))
        at_a, at_b = (points.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}")) for c in "ab")
        edges = edges.join(at_a, "a").join(at_b, "b").select(F.col("top_a").alias("a"), F.col("top_b").alias("b"))
        edges = checkpointed(_no_loops(edges))
        if roots is None:
            roots = points.select("node", F.col("top").alias("root"))
        else:
            moved = points.select(F.col("node").alias("root"), "top")
            roots = roots.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
