"""Connected components of an edge table by alternating large and small stars.

Every round is a few joins and partial aggregates over edges; the edge table is written to
the checkpoint folder each round. No component meets in one task: the minimum of a node's
neighbours is a partial aggregate, and the join that hands it out reads two written tables,
so adaptive execution splits a node with very many neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.session import checkpointed


def _hand_out(edges: DataFrame) -> DataFrame:
    """(u, v, m): each edge with the smallest node among u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))
    least = checkpointed(least)
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def _mark(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); the component is its smallest node.

    Self-loops and repeated edges are harmless; nodes without an edge to another are not returned.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = checkpointed(edges.distinct())
    mark = _mark(edges)
    while True:
        both = checkpointed(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = _hand_out(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.filter("u <> v").distinct())
        small = _hand_out(large)
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        edges = checkpointed(edges)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
