"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import numpy as np
import pandas as pd
import pytest

from corpusloom import catalog

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.load()


def plain(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (float, np.floating)):
        return None if np.isnan(v) else round(float(v), 6)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "isoformat"):
        t = pd.Timestamp(v)
        return t.tz_localize(None) if t.tz is not None else t
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in data)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    if name not in SQL:  # values are compared in the tests of the operators
        assert got and all(c == "error" or any(r[c] is not None for r in got) for c in df.columns)
        return
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    if os.path.isdir(FOLDER):
        assert __spark_entry__.entry(spark).columns
