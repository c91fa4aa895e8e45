"""Connected components by alternating large and small stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: The number of rounds grows with the logarithm of the longest path; this many means a fault.
MOST_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Neighbours of each node are tied to the smallest of them (or to the node itself)."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("to"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("to")))
    else:
        both = edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to"))
    least = both.groupBy("node").agg(F.min("to").alias("least")).select("node", F.least("node", "least").alias("least"))
    tied = both.join(least, "node")
    pairs = tied.filter(F.col("to") > F.col("node")).select(F.col("to").alias("a"), F.col("least").alias("b")) if large else tied.select(F.col("to").alias("a"), F.col("least").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b")))
    return pairs.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges(a, b)``; component: the smallest node reachable.

    A hub costs no quadratic work: a star only re-ties each edge once.  Each round is
    written to the shared folder, so lineage stays short, and removed at the end.  Nodes
    without an edge to another node are not returned.
    """
    with storage.scratch(edges.sparkSession):
        edges = storage.written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        seen = None
        for _ in range(MOST_ROUNDS):
            edges = storage.written(_star(_star(edges, large=True), large=False), "stars")
            now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if now == seen:
                named = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
                return storage.written(named, "components", last=True)
            seen = now
    raise RuntimeError("components did not settle")
