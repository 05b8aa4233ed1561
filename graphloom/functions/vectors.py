"""Cosine over float arrays as Columns, in double, and exact nearest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Results of a vector search at most.
MOST = 100


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector has no length."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in vector))


def nearest(rows: DataFrame, query: Column, k: int, id_column: str, vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest cosine to ``query`` with ``similarity``, best first, ties by id.

    One pass: each task keeps its best ``k`` (TakeOrderedAndProject), so only ids and scores move.
    """
    if not 1 <= k <= MOST:
        raise ValueError(f"k must be between 1 and {MOST}")
    return rows.withColumn("similarity", cosine(F.col(vector), query)).orderBy(F.desc("similarity"), id_column).limit(k)
