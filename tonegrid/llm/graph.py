"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    out = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return out.where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lower neighbours are linked to the least of them."""
    down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    out = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, scratch: common.Scratch, most: int = 50) -> DataFrame:
    """(node, component) of every node with an edge (a < b); a component is its least node.

    Each pass is two aggregations that combine on the map side and two joins whose hot side AQE
    splits; the number of passes grows with the logarithm of the longest path. Every pass is
    written to the shared folder, so a lost executor repeats a pass and not the whole loop.
    """
    edges = scratch.write(edges.select("a", "b").where("a < b").distinct(), "cc")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(edges)
    for _ in range(most):
        if not before[0]:
            break
        edges = scratch.write(_small_star(_large_star(edges)), "cc")
        now = mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {most} passes")
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
