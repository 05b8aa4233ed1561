"""Communities: weighted label propagation, their members and summaries, and a query over summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.graph import certainty

MAX_PASSES = 50


def symmetric(edges: DataFrame) -> DataFrame:
    """Each edge seen from both ends, a self-loop once: ``node``, ``other``, ``weight``."""
    forward = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight")
    return forward.unionByName(edges.where("src <> dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))


def votes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The label that each node's neighbours vote for in one step: ``node``, ``label``, ``score``; ties to the least."""
    seen = symmetric(edges).join(labels.select(F.col("node_id").alias("other"), "label"), "other")
    scored = seen.groupBy("node", "label").agg(F.sum(certainty(F.col("weight"))).alias("score"))
    # Of equal scores the least label: doubles are compared after rounding, as their sums have no order.
    best = scored.withColumn("rounded", F.round("score", 9))
    top = best.groupBy("node").agg(F.max("rounded").alias("rounded"))
    return best.join(top, ["node", "rounded"]).groupBy("node", F.col("rounded").alias("score")).agg(F.min("label").alias("label"))


def propagate(node_ids: list[str], edges: list[tuple[str, str, float]], passes: int = MAX_PASSES) -> tuple[dict[str, str], bool, int]:
    """Labels, whether they settled, and passes. Nodes are visited in order of id and see labels changed before them."""
    labels = {n: n for n in sorted(node_ids)}
    around: dict[str, list[tuple[str, float]]] = {n: [] for n in labels}
    for a, b, certain in edges:
        if a in around and b in around:
            around[a].append((b, certain))
            if a != b:
                around[b].append((a, certain))
    for done in range(1, passes + 1):
        changed = False
        for n in labels:
            scores: dict[str, float] = {}
            for other, certain in sorted(around[n]):
                scores[labels[other]] = scores.get(labels[other], 0.0) + certain
            if scores:
                best = min(scores, key=lambda x: (-round(scores[x], 12), x))
                if best != labels[n]:
                    labels[n], changed = best, True
        if not changed:
            return labels, True, done
    return labels, False, passes


def communities(nodes: DataFrame, edges: DataFrame, by: list[str], passes: int = MAX_PASSES) -> DataFrame:
    """Communities of each namespace (columns ``by``): ``by``, ``node_id``, ``community_id``, ``converged``, ``passes``.

    ``edges`` carry ``by``, ``src``, ``dst``, ``weight``. Order matters within a namespace and is kept there;
    namespaces run side by side, nodes and edges of one meeting in one task.
    """
    rows = nodes.select(*by, F.col("node_id").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("certain"))
    rows = rows.unionByName(edges.select(*by, F.col("src").alias("a"), F.col("dst").alias("b"), certainty(F.col("weight")).alias("certain")))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["b"].isna()]["a"].tolist()
        links = pdf[pdf["b"].notna()]
        labels, settled, done = propagate(own, list(zip(links["a"], links["b"], links["certain"], strict=True)), passes)
        return pd.DataFrame({**{c: [k] * len(labels) for c, k in zip(by, key, strict=True)}, "node_id": list(labels), "community_id": list(labels.values()), "converged": settled, "passes": done})

    kinds = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in by)
    return rows.groupBy(*by).applyInPandas(run, f"{kinds}, node_id string, community_id string, converged boolean, passes int")


def report(memberships: DataFrame, by: list[str]) -> DataFrame:
    """For each run its ``node_count`` and ``community_count``."""
    return memberships.groupBy(*by).agg(F.count("*").alias("node_count"), F.count_distinct("community_id").alias("community_count"))


def members(memberships: DataFrame, by: list[str]) -> DataFrame:
    """Members of each community in order, the largest community first."""
    out = memberships.groupBy(*by, "community_id").agg(F.sort_array(F.collect_list("node_id")).alias("members"), F.count("*").alias("member_count"))
    return out.orderBy(F.desc("member_count"), *by, "community_id")


def latest(runs: DataFrame, by: list[str], at: str = "created_at", run: str = "run_id") -> DataFrame:
    """The newest run of each namespace."""
    return runs.groupBy(*by).agg(F.max_by(F.struct(*(c for c in runs.columns if c not in by)), F.struct(at, run)).alias("r")).select(*by, "r.*")


def summarise(memberships: DataFrame, mentions: DataFrame, chunks: DataFrame, known: DataFrame, generate: Callable[[str], str], most: int = 8) -> DataFrame:
    """``community_id``, ``summary``, ``evidence_hash``, ``reused``: a summary of each community's first chunks by content.

    ``known``: ``community_id``, ``evidence_hash``, ``summary`` of before; where the evidence is unchanged
    that summary is kept and nothing generated.
    """
    found = memberships.join(mentions, "node_id").select("community_id", "chunk_id").distinct().join(chunks.select("chunk_id", "content"), "chunk_id")
    # Of bounded size: of each community the first chunks only are gathered.
    first = found.groupBy("community_id").agg(F.slice(F.array_sort(F.collect_set("content")), 1, most).alias("evidence"))
    first = first.withColumn("evidence_hash", F.sha2(F.array_join("evidence", "\n"), 256))
    old = known.select("community_id", "evidence_hash", F.col("summary").alias("old"))
    rows = first.join(old, ["community_id", "evidence_hash"], "left")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fresh = pdf["old"].isna()
            pdf["summary"] = [generate("\n".join(e)) if f else o for e, o, f in zip(pdf["evidence"], pdf["old"], fresh, strict=True)]
            yield pdf[["community_id", "summary", "evidence_hash"]].assign(reused=~fresh)

    return rows.mapInPandas(write, "community_id string, summary string, evidence_hash string, reused boolean")


def overlap(summaries: DataFrame, question: str, k: int = 5, column: str = "summary", key: str = "community_id") -> DataFrame:
    """The ``k`` summaries with most distinct words of the question, split at white space and lower-cased."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != ""))
    out = summaries.withColumn("overlap", F.size(F.array_intersect(words(F.col(column)), words(F.lit(question)))).cast("long"))
    return out.where("overlap > 0").orderBy(F.desc("overlap"), key).limit(k)
