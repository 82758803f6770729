"""Every query with SQL gives what DuckDB gives; the tables are the smallest."""

from __future__ import annotations

import decimal
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry
from quillon.plans import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    if pd.isna(value):
        return None
    return float(value) if isinstance(value, (int, float, decimal.Decimal)) or hasattr(value, "dtype") else str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as from '{f}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f[sorted(f.columns)].itertuples(index=False)), key=str)
    assert rows(ours) == rows(theirs)


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
