"""Chunk search: semantic, lexical, and both fused by reciprocal rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text, vectors

RRF = 60
CANDIDATES = 40
#: Score of each matching position of a query term.
TERM_SCORE = 0.1


def _ranked(best: DataFrame, *order: Column, name: str) -> DataFrame:
    """Ranks of rows that were cut to a few before: the window sees no more than those."""
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def semantic(chunks: DataFrame, query: Column, k: int = CANDIDATES) -> DataFrame:
    """``chunk_id``, ``similarity`` and ``sem_rank`` of the ``k`` nearest chunks."""
    best = vectors.nearest(chunks.select("chunk_id", "embedding"), query, k, "chunk_id").select("chunk_id", "similarity")
    return _ranked(best, F.desc("similarity"), F.col("chunk_id"), name="sem_rank")


def lexical(chunks: DataFrame, question: str, k: int = CANDIDATES) -> DataFrame:
    """``chunk_id``, ``lex_score`` and ``lex_rank`` of the ``k`` chunks with most positions of any query term."""
    terms = text.query_terms(question)
    hits = F.size(F.filter(text.tokens(F.col("content")), lambda t: t.isin(terms)))
    best = chunks.select("chunk_id", hits.alias("hits")).where("hits > 0").select("chunk_id", (F.col("hits") * TERM_SCORE).alias("lex_score"))
    best = best.orderBy(F.desc("lex_score"), "chunk_id").limit(k)
    return _ranked(best, F.desc("lex_score"), F.col("chunk_id"), name="lex_rank")


def fuse(lex: DataFrame, sem: DataFrame, k: int, rrf: int = RRF) -> DataFrame:
    """The ``k`` chunks of largest sum of 1 / (rrf + rank), a missing side counting nothing; both ranks kept."""
    sides = lex.select("chunk_id", "lex_rank", F.lit(None).cast("long").alias("sem_rank")).unionByName(sem.select("chunk_id", F.lit(None).cast("long").alias("lex_rank"), "sem_rank"))
    both = sides.groupBy("chunk_id").agg(F.max("lex_rank").alias("lex_rank"), F.max("sem_rank").alias("sem_rank"))
    part = lambda c: F.coalesce(1.0 / (rrf + F.col(c)), F.lit(0.0))
    return both.withColumn("rrf_score", part("lex_rank") + part("sem_rank")).orderBy(F.desc("rrf_score"), "chunk_id").limit(k)


def hybrid(chunks: DataFrame, question: str, query: Column, k: int = 10, lexical_candidates: int = CANDIDATES, semantic_candidates: int = CANDIDATES, rrf: int = RRF) -> DataFrame:
    """Fused search with the chunks' other columns joined on at the end, when few rows are left."""
    best = fuse(lexical(chunks, question, lexical_candidates), semantic(chunks, query, semantic_candidates), k, rrf)
    return chunks.drop("embedding").join(F.broadcast(best), "chunk_id")  # k rows at most


def seed_scores(mentions: DataFrame, scored: DataFrame) -> DataFrame:
    """Nodes that the scored chunks mention, each by its best chunk, relative to the best of all.

    ``mentions``: ``chunk_id``, ``node_id``; ``scored``: ``chunk_id``, ``score``. Where no score is
    positive all seeds weigh 1.
    """
    best = mentions.join(scored, "chunk_id").groupBy("node_id").agg(F.max("score").alias("raw"))
    top = best.agg(F.max("raw").alias("top"))
    out = best.crossJoin(F.broadcast(top))  # one row
    return out.select("node_id", F.when(F.col("top") > 0, F.col("raw") / F.col("top")).otherwise(1.0).alias("score"))


def mentioned_nodes(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    return mentions.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("node_id").distinct()
