"""Every query of the entry point against DuckDB on the smallest tables."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from veldra import queries as own

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, float) or getattr(x, "dtype", None) is not None and x.dtype.kind in "fiu" else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(x) for x in r)) for r in df.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(own.QUERIES))
def test_query(spark, duck, name):
    got = own.QUERIES[name](spark, SF).toPandas()
    if name in own.ORACLES:
        want = duck.execute(own.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
