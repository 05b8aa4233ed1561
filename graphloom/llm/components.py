"""Connected components of a distributed edge list, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut


def _stars(edges: DataFrame) -> bool:
    """Whether each node knows one smaller node at most, and none that is known itself knows another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("knows"), F.lit(0).alias("known")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("knows"), F.lit(1).alias("known")))
    seen = ends.groupBy("x").agg(F.sum("knows").alias("knows"), F.max("known").alias("known"))
    return seen.where("knows > 1 or knows = 1 and known = 1").isEmpty()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands the smallest node it knows to its larger (large) or smaller (small) neighbours.

    The least neighbour is an aggregate with map-side combine. The hand-over is a join of the edges with
    one row for each node, so the edges of a node with very many can be split over tasks (adaptive skew join).
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """The component of each node of ``edges`` (``u``, ``v``: long): ``node``, ``component``, its least node.

    Rounds repeat until the edges are stars; their number grows with the logarithm of the longest path.
    Nothing but that answer reaches the driver; each round's edges are cut from their lineage.
    """
    edges = cut(edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(rounds):
        if _stars(edges):
            break
        edges = cut(_star(_star(edges, large=True), large=False))
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
