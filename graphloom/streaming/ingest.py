"""An extension: documents that arrive as files are ingested batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.plans.ingest import Provider, add_documents
from graphloom.sources.store import TenantSession


def documents(spark: SparkSession, path: str) -> DataFrame:
    """A stream of text files: ``source_id``, ``text``."""
    return spark.readStream.format("text").option("wholetext", True).load(path).select(F.input_file_name().alias("source_id"), F.col("value").alias("text"))


def ingest(stream: DataFrame, session: TenantSession, namespace: str, provider: Provider, checkpoint: str) -> StreamingQuery:
    """Runs each micro-batch through the batch plan. Ids follow from content, so a batch that is repeated after a failure changes nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        latest = rows.groupBy("source_id").agg(F.max("text").alias("text"))
        add_documents(session, namespace, latest, provider)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and summed values by kind and window of event time, late ones counted within the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
