"""A thin command line over the engine: setup, ingest, query, status."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators.graph import supported
from graphloom.plans.ingest import Provider, add_documents
from graphloom.plans.retrieve import Retrieval, retrieve
from graphloom.session import local_session
from graphloom.sources import readers
from graphloom.sources.store import Store


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__)
    parser.add_argument("verb", choices=["setup", "ingest", "query", "status"])
    parser.add_argument("value", nargs="?", help="files to ingest, or the question")
    parser.add_argument("--store", required=True)
    parser.add_argument("--tenant", default="default")
    parser.add_argument("--namespace", default="main")
    parser.add_argument("--dimension", type=int, default=64)
    parser.add_argument("--mode", default="hybrid_graph")
    got = parser.parse_args(args)
    spark = local_session()
    store = Store(spark, got.store)
    if got.verb == "status":
        print(json.dumps(store.status()))
        return 0
    store.create(got.dimension)
    session, provider = store.tenant(got.tenant), Provider(got.dimension)
    if got.verb == "ingest":
        add_documents(session, got.namespace, readers.texts(spark, got.value), provider).select("source_id", "extraction_status").show(truncate=False)
    if got.verb == "query":
        scan = lambda t: session.scan(t, got.namespace)
        chunks = scan("chunks").join(scan("documents").select("document_id", "source_id"), "document_id")
        tables = {"chunks": chunks, "nodes": scan("nodes"), "edges": supported(scan("edges"), scan("edge_mentions")), "entity_mentions": scan("entity_mentions"), "edge_mentions": scan("edge_mentions")}
        vector = spark.range(1).select(text.embedding(F.lit(got.value), got.dimension)).first()[0]
        print(retrieve(tables, got.value, vector, Retrieval(mode=got.mode)).context())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
