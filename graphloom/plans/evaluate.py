"""Retrieval modes compared on one set of cases, with reports as files."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators import evaluation, graph
from graphloom.plans import retrieve

Generate = Callable[[str, int], str]


def modes(tables: dict[str, DataFrame], cases: DataFrame, embed: retrieve.Embed, generate: Generate | None = None, which: tuple[str, ...] = retrieve.MODES) -> DataFrame:
    """Each case (as ``readers.incident_cases`` gives them) retrieved in each mode, with its measures and ``ms``.

    Cases are a fixed set of questions, asked one after the other; every retrieval is a plan of its own.
    Of a case that has no answer a grounded one counts as a false connection, where ``generate`` is given.
    """
    spark = cases.sparkSession
    asked = [r.asDict(recursive=True) for r in cases.collect()]
    schema = f"{cases.schema.simpleString()[7:-1].replace(':', ' ')}, mode string, chunks array<string>, entities array<string>, found_relations array<string>, found_sources array<string>, context_tokens long, ms double, grounded boolean"
    rows = []
    for mode in which:
        for case in asked:
            how = retrieve.Retrieval(mode=mode, walk=graph.Walk(hops=case.get("max_hops") or 2))
            began = time.perf_counter()
            found = retrieve.retrieve(tables, case["question"], embed(case["question"]), how)
            took = (time.perf_counter() - began) * 1000
            grounded = bool(retrieve.answer(tables, case["question"], embed(case["question"]), generate, how=how)["grounded"]) if generate and case.get("abstain") else None
            rows.append((*(case[c] for c in cases.columns), mode, [c["content"] for c in found.chunks], [n["content"] for n in found.nodes], [e["relation"] for e in found.edges], [c["source_id"] for c in found.chunks], found.tokens, took, grounded))
    found = spark.createDataFrame(rows, schema).withColumn("key", F.concat_ws("/", "mode", "case_id"))
    scored = evaluation.scored_cases(found.withColumn("case_id", F.col("key"))).withColumnRenamed("case_id", "key")
    out = scored.join(found.select("key", "case_id", "mode", "ms", "grounded"), "key").drop("key")
    return out.withColumn("false_connection", F.coalesce("grounded", F.col("false_connection").cast("boolean")))


def report(scored: DataFrame, path: str | None = None) -> dict[str, DataFrame]:
    """Means by mode, by mode and category, and latencies by mode; written under ``path`` as JSON lines if given."""
    out = {"modes": evaluation.summary(scored, ["mode"]), "categories": evaluation.summary(scored, ["mode", "category"]), "latency": evaluation.percentiles(scored, ["mode"], "ms")}
    if path:
        for name, df in out.items():
            df.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")  # a row for each mode or category
    return out
