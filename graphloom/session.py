"""One place that builds Spark sessions for local use and finds the tables of a data set."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "graphloom", cpus: int | str | None = None, partitions: int | None = None) -> SparkSession:
    """A local session; on a cluster, the caller's own session is used instead."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data set in ``sf_dir``, by Spark's own readers only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reused(df: DataFrame) -> DataFrame:
    """``df`` computed once for the steps that read it again, kept in the folder that all executors share.

    Iterative plans use it, so that each step's plan begins there and stays small. The folder is the one
    in ``spark.checkpoint.dir``; only a local master (tests) may do without: a temporary one takes its place.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", None) and context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint()
