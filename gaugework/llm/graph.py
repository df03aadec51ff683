"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugework.operators.joins import join_hot
from gaugework.session import settled, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the least node it reaches.

    Alternating stars: each node hands its larger neighbours to its least neighbour, then each node
    its smaller ones. Rounds grow with the logarithm of the longest path. The least neighbour comes
    to a node's edges by ``join_hot``, so the centre of a class that holds most nodes is no task of its
    own. Edges and labels stay in tables of the shared folder; self loops, repeated edges and an
    empty table are fine, edges with a null end are left out.
    """
    down = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    mark, before = _mark(down), None
    while mark[0] and mark != before:
        above = down
        down = settled(edges.sparkSession, lambda: _round(above))
        mark, before = _mark(down), mark
    roots = down.select(F.col("v").alias("node")).distinct()
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def _round(down: DataFrame) -> DataFrame:
    """The edges (u > v) after one star over larger and one over smaller neighbours."""
    around = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = join_hot(around, least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = stored(large.distinct())
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = join_hot(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def _mark(down: DataFrame) -> tuple:
    """Number and checksum of the edges; equal after a round that changed nothing."""
    row = down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)
