"""Community runs of a namespace: found when its graph has changed, kept as runs, memberships and summaries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import communities, graph
from graphloom.session import reused
from graphloom.sources.store import TenantSession


def detect(session: TenantSession, namespace: str, force: bool = False, passes: int = communities.MAX_PASSES) -> str | None:
    """Finds the communities of the namespace and keeps them as a run, whose id is returned.

    Nothing is done, and none returned, where the graph hasn't changed since the last run, unless forced.
    """
    if not force and not session.dirty(namespace):
        return None
    nodes, edges = session.scan("nodes", namespace), graph.supported(session.scan("edges", namespace), session.scan("edge_mentions", namespace))
    found = reused(communities.communities(nodes, edges.withColumn("namespace", F.lit(namespace)), ["namespace"], passes))
    run = uuid.uuid4().hex
    memberships = found.select(F.lit(run).alias("run_id"), "node_id", "community_id")
    settled = found.agg(F.coalesce(F.bool_and("converged"), F.lit(True)).alias("converged"), F.coalesce(F.max("passes"), F.lit(0)).alias("passes"))
    counted = memberships.agg(F.count("*").alias("node_count"), F.count_distinct("community_id").alias("community_count"))
    row = settled.crossJoin(counted).withColumns({"run_id": F.lit(run), "created_at": F.current_timestamp()})  # one row
    bare = lambda name: session.scan(name, namespace).drop("tenant_id", "namespace")
    tables = {"community_runs": bare("community_runs").unionByName(row), "community_memberships": bare("community_memberships").unionByName(memberships)}
    session.write(tables, namespace, clean=True)
    return run


def latest_run(session: TenantSession, namespace: str) -> str | None:
    row = communities.latest(session.scan("community_runs", namespace), ["namespace"]).first()
    return row["run_id"] if row else None


def summarise(session: TenantSession, namespace: str, generate: Callable[[str], str]) -> DataFrame:
    """Summaries of the latest run's communities; those whose evidence is as before are not generated again."""
    run = latest_run(session, namespace)
    old = session.scan("community_summaries", namespace).drop("tenant_id", "namespace")
    mine = session.scan("community_memberships", namespace).where(F.col("run_id") == F.lit(run))
    known = old.dropDuplicates(["community_id", "evidence_hash"])
    made = communities.summarise(mine, session.scan("entity_mentions", namespace), session.scan("chunks", namespace), known, generate)
    made = reused(made.withColumn("run_id", F.lit(run)))
    session.write({"community_summaries": old.where(~F.col("run_id").eqNullSafe(F.lit(run))).unionByName(made.drop("reused"))}, namespace, dirty=False)
    return made
