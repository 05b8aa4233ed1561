"""Every registered query of the engine against its SQL, on the smallest data set."""

import glob
import math
import os

import duckdb
import pytest

from graphloom import catalog

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, list | tuple):
        return tuple(norm(x) for x in v)
    try:
        return "nan" if math.isnan(v) else round(float(v), 6)
    except TypeError:
        return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the data sets are not here")
@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(norm(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted(names) == columns
    assert got == want
    spark.catalog.clearCache()
