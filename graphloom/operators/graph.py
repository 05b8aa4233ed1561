"""Property-graph operators over ``nodes`` and ``edges`` DataFrames.

Edges carry ``edge_id``, ``src``, ``dst``, ``relation``, ``support`` (distinct chunks that assert them)
and ``manual`` weight; their weight is the sum, and an edge without either does not exist.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.filters import compiled
from graphloom.session import reused

MAX_HOPS = 5


@dataclass(frozen=True)
class Walk:
    """Which edges count and how far to go."""

    hops: int = 2
    directed: bool = False
    relations: tuple[str, ...] | None = None
    without: tuple[str, ...] | None = None
    min_weight: float = 0.0
    decay: float = 0.7
    fan_out: int = 20
    metadata: dict | list | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.hops <= MAX_HOPS:
            raise ValueError(f"hops must be between 0 and {MAX_HOPS}")


def supported(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """``edges`` with ``support`` counted from ``mentions`` (``edge_id``, ``chunk_id``), ``weight``, and without unsupported ones."""
    counts = mentions.select("edge_id", "chunk_id").distinct().groupBy("edge_id").agg(F.count("*").alias("support"))
    out = edges.drop("support", "weight").join(counts, "edge_id", "left").withColumn("support", F.coalesce("support", F.lit(0).cast("long")))
    return out.where("support > 0 or manual > 0").withColumn("weight", F.col("manual") + F.col("support"))


def usable(edges: DataFrame, walk: Walk) -> DataFrame:
    kept = (F.col("support") > 0) | (F.col("manual") > 0)
    kept = kept & (F.col("weight") >= walk.min_weight)
    if walk.relations is not None:
        kept = kept & F.col("relation").isin(list(walk.relations))
    if walk.without is not None:
        kept = kept & ~F.col("relation").isin(list(walk.without))
    return edges.where(kept)


def neighbours(edges: DataFrame, walk: Walk) -> DataFrame:
    """``edge_id``, ``at``, ``to``, ``relation``, ``weight``: each node's ``fan_out`` heaviest ends of usable edges.

    The rank of an edge at a node doesn't depend on the path there, so it is taken once for all hops;
    what a path may not use still takes its place in the rank. A self-loop takes one.
    """
    own = usable(edges, walk)
    out = own.select("edge_id", F.col("src").alias("at"), F.col("dst").alias("to"), "relation", "weight")
    if not walk.directed:
        out = out.unionByName(own.where("src <> dst").select("edge_id", F.col("dst").alias("at"), F.col("src").alias("to"), "relation", "weight"))
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("weight"), "edge_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= walk.fan_out)


def certainty(weight: Column) -> Column:
    return 1 - F.exp(-weight)


def _allowed(nodes: DataFrame, walk: Walk) -> DataFrame | None:
    return nodes.where(compiled(F.col("metadata"), walk.metadata)).select("node_id") if walk.metadata else None


def traverse(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, walk: Walk | None = None) -> DataFrame:
    """Nodes within ``walk.hops`` of the ``seeds`` (``node_id``, ``score``): ``node_id``, ``hops``, ``score``.

    ``hops`` is the least distance and ``score`` the best product of seed score, decay and certainty over
    any simple path. As no step raises a score, the best walk of a length is never worse than the best
    simple path, and cutting its cycles only helps; so it is enough to keep each node's best score for
    each distance: no more rows than nodes times hops, whatever the number of paths.
    """
    walk = walk or Walk()
    if not 0 <= walk.decay <= 1:
        raise ValueError("decay must be between 0 and 1")
    allowed = _allowed(nodes, walk)
    level = seeds.join(nodes.select("node_id"), "node_id", "left_semi").groupBy("node_id").agg(F.max("score").alias("score"))
    if allowed is not None:
        level = level.join(allowed, "node_id", "left_semi")
    steps = neighbours(edges, walk).where("at <> to").groupBy("at", "to").agg(F.max("weight").alias("weight"))
    steps = steps.join(nodes.select(F.col("node_id").alias("to")), "to", "left_semi")
    if allowed is not None:
        steps = steps.join(allowed.withColumnRenamed("node_id", "to"), "to", "left_semi")
    steps, level = reused(steps), reused(level)
    reached = level.select("node_id", F.lit(0).alias("hops"), "score")
    for hop in range(1, walk.hops + 1):
        level = level.join(steps, level.node_id == steps["at"]).select(F.col("to").alias("node_id"), (F.col("score") * walk.decay * certainty(F.col("weight"))).alias("score"))
        level = reused(level.groupBy("node_id").agg(F.max("score").alias("score")))
        reached = reached.unionByName(level.select("node_id", F.lit(hop).alias("hops"), "score"))
    return reached.groupBy("node_id").agg(F.min("hops").alias("hops"), F.max("score").alias("score"))


def induced(edges: DataFrame, reached: DataFrame, walk: Walk | None = None) -> DataFrame:
    """Usable edges with both ends reached, whether or not a path went over them."""
    ids = reached.select("node_id").distinct()
    out = usable(edges, walk or Walk())
    return out.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")


def shown_score(a: Column, b: Column, weight: Column) -> Column:
    """Mean of the ends' scores times what the weight shows; fixed value: e cut after nine decimals."""
    return (a + b) / 2 * (1 - F.pow(F.lit(2.718281828), -weight))


def _walks(nodes: DataFrame, edges: DataFrame, sources: DataFrame, targets: DataFrame, walk: Walk) -> DataFrame:
    """All simple paths from sources to targets on the capped graph, grown only where a target is near enough."""
    allowed = _allowed(nodes, walk)
    steps = neighbours(edges, walk).where("at <> to")
    steps = steps.join(nodes.select(F.col("node_id").alias("to")), "to", "left_semi")
    if allowed is not None:
        steps = steps.join(allowed.withColumnRenamed("node_id", "to"), "to", "left_semi")
        sources = sources.join(allowed, "node_id", "left_semi")
    steps = reused(steps)
    # Least distance to a target, backwards; a partial path that can't arrive in time is dropped.
    near = targets.select(F.col("node_id").alias("to"), F.lit(0).alias("left"))
    for hop in range(1, walk.hops + 1):
        back = steps.join(near.select("to").distinct(), "to", "left_semi").select(F.col("at").alias("to"), F.lit(hop).alias("left"))
        near = reused(near.unionByName(back.distinct()).groupBy("to").agg(F.min("left").alias("left")))
    step = lambda node, relation, edge: F.struct(node.alias("node_id"), relation.cast("string").alias("relation"), edge.cast("string").alias("edge_id"))
    none = F.lit(None)
    paths = sources.join(near, sources.node_id == near["to"]).where(F.col("left") <= walk.hops)
    paths = paths.select(F.col("node_id").alias("source_id"), F.col("node_id").alias("end"), F.lit(0).alias("depth"), F.lit(1.0).alias("score"), F.array(F.col("node_id")).alias("seen"), F.array(step(F.col("node_id"), none, none)).alias("path"))
    every = paths = reused(paths)
    steps = reused(steps.join(near, "to"))
    for hop in range(1, walk.hops + 1):
        grown = paths.join(steps, paths["end"] == steps["at"]).where((F.col("left") <= walk.hops - hop) & ~F.array_contains("seen", F.col("to")))
        paths = grown.select(
            "source_id", F.col("to").alias("end"), F.lit(hop).alias("depth"), (F.col("score") * certainty(F.col("weight"))).alias("score"),
            F.array_append("seen", F.col("to")).alias("seen"), F.array_append("path", step(F.col("to"), F.col("relation"), F.col("edge_id"))).alias("path"),
        )
        paths = reused(paths)
        every = every.unionByName(paths)
    return every.join(targets.select(F.col("node_id").alias("end")), "end", "left_semi").drop("seen")


def top_paths(nodes: DataFrame, edges: DataFrame, sources: DataFrame, targets: DataFrame, walk: Walk | None = None, k: int = 5) -> DataFrame:
    """The ``k`` best simple paths over all pairs: ``source_id``, ``target_id``, ``depth``, ``score``, ``path``.

    A node in both sets is a path of no steps. Ties: fewer steps, then the path itself.
    """
    found = _walks(nodes, edges, sources.select("node_id").distinct(), targets.select("node_id").distinct(), replace(walk or Walk(hops=3), decay=1.0))
    order = (F.desc("score"), F.col("depth"), F.col("source_id"), F.transform("path", lambda p: F.struct(p["node_id"], p["edge_id"])))
    return found.orderBy(*order).limit(k).select("source_id", F.col("end").alias("target_id"), "depth", "score", "path")


def best_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, walk: Walk | None = None) -> DataFrame:
    """The best simple path from ``source`` to ``target``; no row for the same node or where none exists."""
    walk = walk or Walk(hops=3)
    one = lambda x: nodes.where(F.col("node_id") == x).select("node_id").limit(1)
    if source == target:
        return top_paths(nodes, edges, one(source), one(target), walk, 1).where(F.lit(False))
    return top_paths(nodes, edges, one(source), one(target), walk, 1)


def evidence(mentions: DataFrame, chunks: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """The chunks that mention each ``key`` with their documents, by source and ordinal."""
    out = mentions.join(chunks, "chunk_id").join(documents, "document_id")
    return out.select(key, "chunk_id", "document_id", "source_id", "ordinal", "content").distinct()


def decorated(paths: DataFrame, proof: DataFrame) -> DataFrame:
    """Paths with ``evidence``: for every step's edge its chunk ids, in one join for all paths and steps."""
    steps = paths.select("source_id", "target_id", "path", F.explode(F.transform("path", lambda p: p["edge_id"])).alias("edge_id")).where("edge_id is not null")
    found = steps.join(proof.select("edge_id", F.struct("source_id", "ordinal", "chunk_id").alias("e")), "edge_id")
    found = found.groupBy("source_id", "target_id", "path").agg(F.sort_array(F.collect_set("e")).alias("evidence"))
    return paths.join(found, ["source_id", "target_id", "path"], "left")
