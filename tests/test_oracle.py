"""Core queries against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from hanweave.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if x is None or type(x).__name__ in ("NAType", "NaTType") or (isinstance(x, float) and x != x):
        return None
    return x.item() if hasattr(x, "item") else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables are missing")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = entry.queries()[name](spark, DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(found) > 0
        return
    wanted = duck.sql(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    rows = lambda frame: sorted(repr([plain(y) for y in r]) for r in frame[columns].itertuples(index=False))
    assert rows(found) == rows(wanted)
