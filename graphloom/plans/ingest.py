"""Ingestion as one batch plan: documents to chunks, embeddings, triplets, nodes, edges and mentions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators.resolve import merged_json, resolve
from graphloom.sources import readers
from graphloom.sources.store import TenantSession, make_id, replace_chunks, unfinished, upsert_documents

MOST_CHUNKS = 5000
Extract = Callable[[str], list[tuple[str, str, str]]]
Embed = Callable[[list[str]], list[list[float]]]


class Provider:
    """What ingestion asks of a model. The default needs none: hashed words and a pattern for triplets.

    Give ``extract`` or ``embed`` for a model of your own; they run in batches on the executors, and a
    failing chunk is tried again ``retries`` times before it counts as failed.
    """

    def __init__(self, dimension: int, name: str = "offline", model: str = "pattern", prompt: str = "1", extract: Extract | None = None, embed: Embed | None = None, retries: int = 3):
        self.dimension, self.name, self.model, self.prompt, self.retries = dimension, name, model, prompt, retries
        self._extract, self._embed = extract, embed

    def embedded(self, rows: DataFrame, column: str, to: str = "embedding") -> DataFrame:
        if self._embed is None:
            return rows.withColumn(to, text.embedding(F.col(column), self.dimension).cast("array<float>"))
        embed = self._embed

        @F.pandas_udf("array<float>")
        def call(x: pd.Series) -> pd.Series:
            return pd.Series(embed(x.tolist()))

        return rows.withColumn(to, call(F.col(column)))

    def extracted(self, rows: DataFrame) -> DataFrame:
        """``content_hash``, ``content`` → ``content_hash``, ``status``, ``result``."""
        if self._extract is None:
            return rows.select("content_hash", F.lit("done").alias("status"), text.triplets(F.col("content")).alias("result"))
        extract, retries = self._extract, self.retries

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for content in pdf["content"]:
                    for left in range(retries, -1, -1):
                        try:
                            out.append(("done", [dict(zip(("subject", "predicate", "object"), t, strict=True)) for t in extract(content)]))
                            break
                        except Exception:  # a provider may fail in any way; what fails for good is kept as such
                            if not left:
                                out.append(("failed", []))
                yield pd.DataFrame({"content_hash": pdf["content_hash"], "status": [s for s, _ in out], "result": [r for _, r in out]})

        return rows.select("content_hash", "content").mapInPandas(run, f"content_hash string, status string, result {readers.TRIPLETS}")


def chunked(documents: DataFrame, size: int = text.CHUNK_SIZE, overlap: int = text.CHUNK_OVERLAP) -> DataFrame:
    """``document_id``, ``ordinal``, ``content``, ``content_hash``, ``chunk_id``; raises on too many chunks."""
    cut = text.chunks(F.col("text"), size, overlap)
    cut = F.when(F.size(cut) > MOST_CHUNKS, F.raise_error(F.lit(f"a document has more than {MOST_CHUNKS} chunks"))).otherwise(cut)
    out = documents.select("document_id", F.posexplode(cut).alias("ordinal", "content")).withColumn("content_hash", text.content_hash(F.col("content")))
    return out.withColumn("chunk_id", make_id(F.col("document_id"), F.col("ordinal"), F.col("content_hash")))


def edge_id(src: Column, dst: Column, relation: Column) -> Column:
    return make_id(src, dst, relation)


def wired(found: DataFrame, nodes: DataFrame, provider: Provider, fuzzy: bool = True) -> dict[str, DataFrame]:
    """Nodes, edges and mentions that ``found`` (``chunk_id``, ``subject``, ``predicate``, ``object``) adds to ``nodes``.

    ``links`` has a row for each row of ``found`` that is no self-loop, with its further columns.
    """
    names = found.select(F.explode(F.array("subject", "object")).alias("name")).distinct().withColumn("at", F.col("name"))
    mapped = resolve(provider.embedded(names, "name"), nodes, fuzzy).select("name", "content", "how")
    node = lambda c: make_id(F.col(c))
    fresh = provider.embedded(mapped.where("how = 'new'").select("content").distinct(), "content").withColumn("node_id", node("content")).withColumn("metadata", F.lit("{}"))
    known = nodes.select("node_id", "content").unionByName(fresh.select("node_id", "content"))
    ids = mapped.join(known, "content").select("name", "node_id")
    a, b = ids.select(F.col("name").alias("subject"), F.col("node_id").alias("src")), ids.select(F.col("name").alias("object"), F.col("node_id").alias("dst"))
    links = found.join(a, "subject").join(b, "object")
    entity_mentions = links.select("chunk_id", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    links = links.where("src <> dst").withColumnRenamed("predicate", "relation").drop("subject", "object").withColumn("edge_id", edge_id(F.col("src"), F.col("dst"), F.col("relation")))
    edges = links.select("edge_id", "src", "dst", "relation").distinct().withColumn("manual", F.lit(0.0)).withColumn("metadata", F.lit("{}"))
    return {"nodes": fresh.select("node_id", "content", "embedding", "metadata"), "edges": edges, "entity_mentions": entity_mentions, "edge_mentions": links.select("chunk_id", "edge_id").distinct(), "links": links}


def _added(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def add_documents(session: TenantSession, namespace: str, documents: DataFrame, provider: Provider) -> DataFrame:
    """Brings ``documents`` (``source_id``, ``text``, ``metadata``) into the namespace; returns their status.

    Unchanged texts are left alone; changed ones have their chunks replaced; every text of a chunk is
    extracted once, whatever the document; edges and mentions follow from the triplets.
    """
    spark = session.store.spark
    rows = readers.document_ids(readers.checked(documents), str(session.tenant_id), namespace)
    if "metadata" not in rows.columns:
        rows = rows.withColumn("metadata", F.lit("{}"))
    rows = rows.withColumn("content_hash", text.content_hash(F.col("text")))
    old = {t: session.scan(t, namespace) for t in ("documents", "chunks", "extractions", "nodes", "edges", "entity_mentions", "edge_mentions")}
    docs = upsert_documents(old["documents"], rows.select("document_id", "source_id", "content_hash", "metadata"))
    changed = rows.join(docs.where("content_changed").select("document_id"), "document_id", "left_semi")
    fresh = provider.embedded(chunked(changed), "content").withColumn("metadata", F.lit("{}")).withColumn("status", F.lit("active"))
    chunks = replace_chunks(old["chunks"].drop("tenant_id", "namespace"), fresh)
    todo = unfinished(fresh, old["extractions"].where((F.col("provider") == provider.name) & (F.col("model") == provider.model) & (F.col("prompt_version") == provider.prompt)))
    made = provider.extracted(todo.select("content_hash", "content").dropDuplicates(["content_hash"]))
    made = made.withColumns({"provider": F.lit(provider.name), "model": F.lit(provider.model), "prompt_version": F.lit(provider.prompt)})
    extractions = old["extractions"].where("status = 'done'").unionByName(made, allowMissingColumns=True)
    session.write({"documents": docs, "chunks": chunks, "extractions": extractions}, namespace)
    return _wire(session, namespace, changed.select("document_id").distinct(), provider, spark)


def _wire(session: TenantSession, namespace: str, changed: DataFrame, provider: Provider, spark) -> DataFrame:
    chunks, extractions = session.scan("chunks", namespace), session.scan("extractions", namespace)
    nodes, edges = session.scan("nodes", namespace), session.scan("edges", namespace)
    live = chunks.select("chunk_id")
    found = chunks.join(extractions.where("status = 'done'").dropDuplicates(["content_hash"]), "content_hash").select("chunk_id", F.explode("result").alias("t")).select("chunk_id", "t.*")
    new = wired(found, nodes, provider)
    keep = lambda name: session.scan(name, namespace).drop("tenant_id", "namespace").join(live, "chunk_id", "left_semi")
    mentions = keep("entity_mentions").unionByName(new["entity_mentions"]).distinct()
    edge_mentions = keep("edge_mentions").unionByName(new["edge_mentions"].select("chunk_id", "edge_id"), allowMissingColumns=True).distinct()
    failed = chunks.join(unfinished(chunks, extractions).select("chunk_id"), "chunk_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("open"))
    every = chunks.groupBy("document_id").agg(F.count("*").alias("all"))
    docs = session.scan("documents", namespace).join(every, "document_id", "left").join(failed, "document_id", "left")
    open_chunks = F.coalesce("open", F.lit(0))
    status = F.when(open_chunks == 0, "ready").when(open_chunks < F.col("all"), "partial").otherwise("failed")
    docs = docs.withColumn("extraction_status", status).drop("all", "open")
    session.write({"documents": docs, "nodes": _added(nodes.drop("tenant_id", "namespace"), new["nodes"], ["node_id"]), "edges": _added(edges.drop("tenant_id", "namespace"), new["edges"], ["edge_id"]), "entity_mentions": mentions, "edge_mentions": edge_mentions}, namespace)
    return session.scan("documents", namespace)


def retry(session: TenantSession, namespace: str, provider: Provider) -> DataFrame:
    """Extracts what is unfinished once more, wires it, and returns the documents' status."""
    chunks, extractions = session.scan("chunks", namespace), session.scan("extractions", namespace)
    made = provider.extracted(unfinished(chunks, extractions).select("content_hash", "content").dropDuplicates(["content_hash"]))
    made = made.withColumns({"provider": F.lit(provider.name), "model": F.lit(provider.model), "prompt_version": F.lit(provider.prompt)})
    session.write({"extractions": extractions.where("status = 'done'").unionByName(made, allowMissingColumns=True)}, namespace)
    return _wire(session, namespace, chunks.select("document_id").distinct(), provider, session.store.spark)


def add_triplets(session: TenantSession, namespace: str, triplets: DataFrame, provider: Provider) -> None:
    """Facts stated by hand: ``subject``, ``predicate``, ``object`` and if given ``weight`` (else 1) and ``metadata``.

    Weights of what is stated again, in one call or a later one, are summed; of its metadata the later fields win.
    """
    more = {"weight": F.lit(1.0), "metadata": F.lit("{}")}
    found = triplets.select(F.lit("manual").alias("chunk_id"), "subject", "predicate", "object", *((c if c in triplets.columns else v.alias(c)) for c, v in more.items()))
    found = found.withColumn("at", F.monotonically_increasing_id())
    new = wired(found, session.scan("nodes", namespace), provider)
    edges = upsert_edges(session.scan("edges", namespace).drop("tenant_id", "namespace"), new["links"].select("src", "dst", "relation", "weight", "metadata", "at"))
    session.write({"nodes": _added(session.scan("nodes", namespace).drop("tenant_id", "namespace"), new["nodes"], ["node_id"]), "edges": edges}, namespace)


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old`` edges with ``new`` ones (``src``, ``dst``, ``relation``, ``weight``, ``metadata``) added to their manual weights.

    Rows of ``new`` for one edge are summed, and their metadata merged in the order of ``at``, if there is
    such a column, or else of the rows; later fields win.
    """
    new = new if "at" in new.columns else new.withColumn("at", F.monotonically_increasing_id())
    summed = new.groupBy("src", "dst", "relation").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("added"), F.sort_array(F.collect_list(F.struct("at", "metadata"))).alias("all"))
    summed = summed.withColumn("new_metadata", F.aggregate("all", F.lit("{}"), lambda a, e: merged_json(a, e["metadata"]))).drop("all")
    both = old.join(summed, ["src", "dst", "relation"], "full_outer")
    return both.select(
        F.coalesce("edge_id", edge_id(F.col("src"), F.col("dst"), F.col("relation"))).alias("edge_id"), "src", "dst", "relation",
        (F.coalesce("manual", F.lit(0.0)) + F.coalesce("added", F.lit(0.0))).alias("manual"), merged_json(F.col("metadata"), F.col("new_metadata")).alias("metadata"),
    )
