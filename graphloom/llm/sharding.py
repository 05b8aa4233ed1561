"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_or_empty
from graphloom.llm.prefix import prefix_sums

SHARDS = 24


def balanced_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of ``docs`` (``doc_id``, ``text``) in one of ``shards`` shards, contiguous by ``doc_id``.

    Returns ``doc_id``, ``size`` (UTF-8 bytes of the text and eight more), ``text_crc32``, ``law``
    (``bytes``), ``shard``, ``slot`` (place in the shard, from 0) and ``grown_shard`` (null: this law
    moves documents when shards are added). A document goes to the shard in whose equal share of all
    bytes its middle byte lies, so a shard misses its share by less than one document. Null texts are
    empty; rows without a ``doc_id`` come first; ties and repeated rows follow each other by checksum
    and size, which makes equal rows alike. An empty table has no rows. Other columns are not read.
    """
    text = text_or_empty()
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"), F.lit(1).cast("long").alias("row"))
    placed = prefix_sums(slim, ["doc_id", "text_crc32", "size"], ["size", "row"])
    total = placed.agg(F.sum("size").alias("total"))
    placed = placed.crossJoin(F.broadcast(total))  # one row
    middle = F.expr(f"least({shards - 1}, ((2 * before_size + size) * {shards}) div (2 * total))").cast("int")
    placed = placed.withColumn("shard", middle)
    first = placed.groupBy("shard").agg(F.min("before_row").alias("first"))  # one row for each shard
    placed = placed.join(F.broadcast(first), "shard")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before_row") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
