"""The corpus pipeline: each stage works on all that the one before it kept.

No stage reads columns other than ``doc_id``, ``text`` and ``source``; all but the last hand every column on, whatever its
name. An empty table gives an empty one. Texts of any length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, mixing, neardup, quality, sharding
from graphloom.llm.common import Scratch
from graphloom.session import table


def judge(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like any other; equal texts score alike."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of least ``doc_id``.

    Null, empty and wordless texts are no copies of each other, and rows without a ``doc_id`` are kept. Rows that repeat
    a ``doc_id`` are one document: they are kept or dropped together.
    """
    dropped = neardup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_dropped"))
    dropped = Scratch(spark).table(dropped.distinct(), "dropped")
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without a text or a ``doc_id`` are kept, and rows of one ``doc_id`` go together."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def remix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null is a source of its own, equal rows at the boundary are taken alike."""
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row of the mix; rows without a ``doc_id`` come first, equal rows follow each other."""
    return sharding.balanced_shards(docs)


STAGES = [("quality classifier", judge), ("MinHash near-dedup", deduplicate), ("benchmark decontamination", decontaminated), ("mixing sources to target weights", remix), ("sharding", shard)]

#: No SQL: the network of the first stage can't be expressed in it. See tests/llm/test_imatch_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again by the next."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
