import pytest
from pyspark.sql import functions as F

#: Texts that every operator must take: null, empty, blank, short, repeated, of other scripts, and long.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "word"), (5, "word"), (5, "word"), (None, "a null id"), (6, "naïve façade Ünïcode 漢字 😀 end"), (7, "x" * 20000), (8, "a b " * 4000)]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with more columns, some of names that operators use themselves."""
    rows = [(d, t, "src" if (d or 0) % 2 else None, "n", 7, "r") for d, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, node string, size int, rank string").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where(F.lit(False))
