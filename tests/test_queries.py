"""Every query with SQL gives DuckDB's rows on the smallest tables; every other one gives rows."""

import math
import os

import duckdb
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"


def cells(frame):
    frame = frame[sorted(frame.columns)]

    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "None"
        x = x.item() if hasattr(x, "item") else x
        if isinstance(x, float):
            return str(int(x)) if x == int(x) else repr(round(x, 10))
        return str(x)

    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = cells(registry.QUERIES[name](spark, DATA).toPandas())
    if name in registry.ORACLE_SQL:
        assert got == cells(duck.execute(registry.ORACLE_SQL[name]).df())
    else:
        assert got[1]
