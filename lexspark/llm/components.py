"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import forget, saved


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge; edges: a, b (long).

    Each round hangs every node's larger neighbours, then its smaller ones, on the smallest node
    it sees; the number of rounds grows with the logarithm of the longest path. Sums for a node
    are made within each task before a shuffle, and joins on a hub may be split, so no node's
    neighbours are gathered. Loops, repeated edges and nulls don't matter. A round keeps its
    edges, no more than the graph had, in a table.
    """
    now = saved(_ordered(edges.dropna()), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _ordered(both.where("b > a").join(least, "a").select("m", F.col("b").alias("a")).toDF("a", "b"))
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        hung = large.join(small, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        old, now = now, saved(_ordered(hung.unionByName(small.select(F.col("m").alias("a"), "b"))), "edges")
        forget(old)
        if (new := _mark(now)) == mark:
            break
        mark = new
    # all edges are now from a component's smallest node
    return now.select(
        F.col("b").alias("node"), F.col("a").alias("component")
    ).unionByName(now.select("a", "a").toDF("node", "component").distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from the smaller node to the larger."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """What tells one set of edges from another."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())
