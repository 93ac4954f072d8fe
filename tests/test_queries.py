"""Every core query runs on the smallest tables; those with SQL give the same rows in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillspark.plans import oracles, queries

QUERIES, SQL = queries.queries(), oracles.oracle_sql()


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT:
            return "null"
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v).tz_localize(None))
        if hasattr(v, "item") and not hasattr(v, "__len__"):
            v = v.item()
        return str(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(one(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
