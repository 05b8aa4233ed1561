"""Retrieval as one plan: search, seeds, traversal, budgets, evidence; and answers on top of it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text, vectors
from graphloom.functions.filters import compiled
from graphloom.operators import graph, grounding, search
from graphloom.sources.store import active

Embed = Callable[[str], list[float]]

MODES = ("vector", "hybrid", "hybrid_graph")


@dataclass(frozen=True)
class Retrieval:
    """How much to retrieve. The defaults."""

    mode: str = "hybrid_graph"
    top_k: int = 5
    walk: graph.Walk = field(default_factory=graph.Walk)
    max_context_nodes: int = 25
    max_context_edges: int = 50
    max_context_tokens: int = 4000
    graph_seed_chunks: int = 1

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not 1 <= self.top_k <= vectors.MOST or not 1 <= self.graph_seed_chunks <= self.top_k:
            raise ValueError("top_k is 1 to 100, and no more chunks are seeds than that")
        if min(self.max_context_nodes, self.max_context_edges, self.max_context_tokens) <= 0:
            raise ValueError("budgets must be positive")


@dataclass
class Retrieved:
    """What was found: rows of at most the budgets' sizes, best first."""

    chunks: list
    nodes: list
    edges: list
    tokens: int

    def context(self) -> str:
        """The text that a model is shown."""
        # The titles of the sections and the form of their lines.
        if not self.chunks and not self.nodes:
            return "No relevant context found."
        parts = ["Relevant Passages:", *(f"- [{c['source_id']}#{c['ordinal']}] {c['content']}" for c in self.chunks)]
        if self.nodes:
            parts += ["\nRelated Entities:", *(f"- {n['content']} (score: {n['score']:.2f}, hops: {n['hops']})" for n in self.nodes)]
        if self.edges:
            parts += ["\nRelationships:", *(f"- {e['src_content']} --[{e['relation']}]--> {e['dst_content']}" for e in self.edges)]
        return "\n".join(parts)


def within_budget(items: Column, cost: Callable[[Column], Column], budget: int) -> Column:
    """Of an array in order the items that fit one after the other: one that doesn't is skipped, later ones may still fit.

    A running sum over a window would stop at the first that doesn't fit, so this is a fold.
    """
    kind = F.struct(F.lit(0).cast("long").alias("used"), F.slice(items, 1, 0).alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + cost(x) <= budget
        return F.when(fits, F.struct((s["used"] + cost(x)).alias("used"), F.array_append(s["kept"], x).alias("kept"))).otherwise(s)

    return F.aggregate(items, kind, step, lambda s: s["kept"])


def _take(rows: list, cost: Callable, left: int, most: int | None = None) -> tuple[list, int]:
    kept = []
    for r in rows:
        need = max(1, (len(cost(r)) + 3) // 4)
        if need <= left and (most is None or len(kept) < most):
            kept.append(r)
            left -= need
    return kept, left


def seed_chunks(chunks: list, question: str, n: int) -> list:
    """The chunks with most of the question's identifiers, then as ranked; of the first ``n``."""
    import re

    loose = lambda s: re.sub("[-_.]+", " ", s.lower())
    wanted = list(dict.fromkeys(m.lower() for m in re.findall(text.IDENTIFIER, question)))
    return sorted(chunks, key=lambda c: -sum(loose(a) in loose(c["content"]) for a in wanted))[:n]


def retrieve(tables: dict[str, DataFrame], question: str, query: list[float], how: Retrieval | None = None) -> Retrieved:
    """Retrieves from the tables of one namespace: ``chunks`` (``chunk_id``, ``source_id``, ``ordinal``, ``content``,
    ``metadata``, ``embedding``), ``nodes``, ``edges`` (derived view), ``entity_mentions``, ``edge_mentions``.

    Only results within the budgets reach the driver; search, seeds, traversal and induced edges are
    plans over the tables.
    """
    how = how or Retrieval()
    if not question.strip():
        raise ValueError("the question is empty")
    chunks = active(tables["chunks"]).where(compiled(F.col("metadata"), how.walk.metadata))
    vector = vectors.literal(query)
    if how.mode == "vector":
        best = search.semantic(chunks, vector, how.top_k).withColumn("rrf_score", 1.0 / (search.RRF + F.col("sem_rank")))
        found = chunks.drop("embedding").join(F.broadcast(best), "chunk_id")  # top_k rows
    else:
        found = search.hybrid(chunks, question, vector, how.top_k)
    rows = [r.asDict() for r in found.orderBy(F.desc("rrf_score"), "chunk_id").collect()]
    kept, left = _take(rows, lambda r: r["content"], how.max_context_tokens)
    if how.mode != "hybrid_graph" or not kept:
        return Retrieved(kept, [], [], how.max_context_tokens - left)
    spark = tables["chunks"].sparkSession
    picked = seed_chunks(kept, question, how.graph_seed_chunks)
    seeds = search.seed_scores(tables["entity_mentions"], spark.createDataFrame([(r["chunk_id"], float(r["rrf_score"])) for r in picked], "chunk_id string, score double"))
    reached = graph.traverse(tables["nodes"], tables["edges"], seeds, how.walk)
    order = (F.desc("score"), F.col("hops"), F.col("content"), F.col("node_id"))
    top = [r.asDict() for r in reached.join(tables["nodes"].select("node_id", "content"), "node_id").orderBy(*order).limit(how.max_context_nodes).collect()]
    nodes, left = _take(top, lambda r: r["content"], left)
    if not nodes:
        return Retrieved(kept, [], [], how.max_context_tokens - left)
    own = F.broadcast(spark.createDataFrame([(n["node_id"], n["content"], float(n["score"])) for n in nodes], "node_id string, content string, score double"))  # max_context_nodes rows
    side = lambda p: own.select(F.col("node_id").alias(p), F.col("content").alias(f"{p}_content"), F.col("score").alias(f"{p}_score"))
    edges = graph.induced(tables["edges"], own, how.walk).join(side("src"), "src").join(side("dst"), "dst")
    edges = edges.withColumn("score", graph.shown_score(F.col("src_score"), F.col("dst_score"), F.col("weight")))
    edges = edges.orderBy(F.desc("score"), F.desc("weight"), "relation", "src", "dst").limit(how.max_context_edges)
    shown, left = _take([r.asDict() for r in edges.collect()], lambda e: f"{e['src_content']} {e['relation']} {e['dst_content']}", left)
    if shown:
        asserted = tables["edge_mentions"].where(F.col("edge_id").isin([e["edge_id"] for e in shown])).select("chunk_id").distinct()
        more = active(tables["chunks"]).join(asserted, "chunk_id").drop("embedding").orderBy("source_id", "ordinal").limit(how.max_context_edges)
        have = {c["chunk_id"] for c in kept}
        extra, left = _take([r.asDict() | {"rrf_score": 0.0} for r in more.collect() if r["chunk_id"] not in have], lambda r: r["content"], left)
        kept += extra
    return Retrieved(kept, nodes, shown, how.max_context_tokens - left)


def answer(tables: dict[str, DataFrame], question: str, query: list[float], generate: Callable[[str, int], str], mode: str = "verified", how: Retrieval | None = None, max_tokens: int = 1500) -> dict:
    """An answer with citations that was checked against what was retrieved: ``text``, ``status``, ``grounded``, ``reason``.

    It abstains where nothing is found or an identifier of the question is in none of the evidence. An
    empty generation is tried once more with twice the budget.
    """
    if mode not in grounding.MODES:
        raise ValueError(f"mode must be one of {grounding.MODES}")
    spark = tables["chunks"].sparkSession
    found = retrieve(tables, question, query, how)
    abstained = lambda reason: {"text": grounding.ABSTENTION, "status": "abstained", "grounded": False, "reason": reason, "retrieved": found}
    if not found.chunks:
        return abstained("no evidence retrieved")
    evidence = [(f"[{c['source_id']}#{c['ordinal']}]", c["content"]) for c in found.chunks]
    pool = spark.createDataFrame([(question, "\n".join(c for _, c in evidence))], "question string, evidence string")
    missing = pool.select(grounding.missing_anchors(F.col("question"), F.col("evidence")).alias("m")).first()["m"]
    if missing:
        return abstained(f"not in the evidence: {', '.join(missing)}")
    prompt = f"Answer from the passages alone. End every factual sentence with its citation markers as shown.\n\n{found.context()}\n\nQuestion: {question}\nAnswer:"
    said = generate(prompt, max_tokens) or generate(prompt, 2 * max_tokens)
    if not said or said.strip() == grounding.ABSTENTION:
        return abstained("the model declined")
    allowed = F.array(*(F.lit(m) for m, _ in evidence))
    row = spark.createDataFrame([(said, evidence)], "answer string, evidence array<struct<marker:string,content:string>>")
    if mode == "citation_only":
        valid = row.select(grounding.citation_only(F.col("answer"), allowed)).first()[0]
        return {"text": said if valid else grounding.ABSTENTION, "status": "citation_valid_only" if valid else "insufficient", "grounded": bool(valid), "reason": None, "retrieved": found}
    split = row.select(F.lit("a").alias("answer_id"), "evidence", F.posexplode_outer(grounding.claims(F.col("answer"))).alias("at", "c"))
    if split.where("c is not null").isEmpty():
        return abstained("no cited claim")
    checked = grounding.verdicts(split.select("answer_id", "at", "evidence", F.col("c.text").alias("claim"), F.col("c.citations").alias("citations")))
    status = grounding.policy(checked, mode)
    out = grounding.rendered(checked, status).join(status.select("answer_id", "grounded"), "answer_id").first()
    return {"text": out["text"], "status": out["status"], "grounded": out["grounded"], "reason": None, "retrieved": found}


def named(nodes: DataFrame, vector: list[float]) -> str | None:
    """The node whose vector is nearest."""
    row = vectors.nearest(nodes.where("embedding is not null").select("node_id", "embedding"), vectors.literal(vector), 1, "node_id").first()
    return row["node_id"] if row else None


def explain_connection(nodes: DataFrame, edges: DataFrame, first: list[float], second: list[float], walk: graph.Walk | None = None) -> str | None:
    """The best path between the nodes nearest to two vectors, as text."""
    a, b = named(nodes, first), named(nodes, second)
    row = graph.best_path(nodes, edges, a, b, walk).first() if a and b else None
    if row is None:
        return None
    names = {r["node_id"]: r["content"] for r in nodes.where(F.col("node_id").isin([p["node_id"] for p in row["path"]])).select("node_id", "content").collect()}
    out = names[row["path"][0]["node_id"]]
    for step in row["path"][1:]:
        out += f" --{step['relation']}--> {names[step['node_id']]}"
    return out


def _nearest(nodes: DataFrame, names: list[str], embed: Embed) -> DataFrame:
    """The nodes nearest to the names, one for each: ``node_id``."""
    found = [n for n in (named(nodes, embed(name)) for name in names) if n]
    return nodes.sparkSession.createDataFrame([(n,) for n in dict.fromkeys(found)], "node_id string")


def find_paths(nodes: DataFrame, edges: DataFrame, sources: list[str], targets: list[str], embed: Embed, walk: graph.Walk | None = None, k: int = 5) -> DataFrame:
    """The ``k`` best paths between entities given by name, each the node nearest to it."""
    return graph.top_paths(nodes, edges, _nearest(nodes, sources, embed), _nearest(nodes, targets, embed), walk, k)


def neighbourhood(nodes: DataFrame, edges: DataFrame, names: list[str], embed: Embed, walk: graph.Walk | None = None) -> DataFrame:
    """What lies around entities given by name: ``node_id``, ``hops``, ``score``; each name starts with score 1."""
    return graph.traverse(nodes, edges, _nearest(nodes, names, embed).withColumn("score", F.lit(1.0)), walk)


def entity(nodes: DataFrame, entity_mentions: DataFrame, chunks: DataFrame, documents: DataFrame, name: str, embed: Embed) -> DataFrame:
    """The node nearest to a name with the documents that mention it, a row for each: ``node_id``, ``content``, ``document_id``, ``source_id``.

    Documents are null where none mentions it; no row where there are no nodes.
    """
    node = _nearest(nodes, [name], embed).join(nodes.select("node_id", "content"), "node_id")
    mentions = entity_mentions.join(node.select("node_id"), "node_id", "left_semi")
    found = graph.evidence(mentions, chunks, documents, "node_id").select("node_id", "document_id", "source_id").distinct()
    return node.join(found, "node_id", "left")
