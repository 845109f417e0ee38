"""Connected components by alternating large and small stars over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webframe.session import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges``: distinct (u, v) with u > v. Every group is reduced to its least member before the rows meet it."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u").filter(F.col("v") > F.col("u"))
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return out.select("e.u", "e.v").filter(F.col("u") != F.col("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of ``edges`` (u, v) that has an edge.

    Each round is linear in the edges and checkpointed in the shared folder; rounds grow with the logarithm of the
    longest path. At the end every edge leads to its component's least node.
    """
    edges = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut(edges)
    before = _digest(edges)
    while before[0]:
        edges = cut(_star(_star(edges, True), False))
        now = _digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v"), F.col("v")).distinct())


def joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found`` (node, component) with ``edges`` (u, v) besides, cut. Rounds run over the components that edges connect, not
    over all nodes."""
    edges = cut(edges)
    side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    met = edges.join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    over = cut(components(met))
    fresh = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    every = found.unionByName(fresh.select("node", F.col("node").alias("component")))
    now = every.join(over.select(F.col("node").alias("component"), F.col("component").alias("over")), "component", "left")
    return cut(now.select("node", F.coalesce("over", "component").alias("component")))
