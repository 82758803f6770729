"""Training-data queries with SQL give what DuckDB gives; the tables are the smallest."""

from __future__ import annotations

from pathlib import Path

import pandas as pd
import pytest

from quillon.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"create view {f.stem} as from '{f}'")
    ours, theirs = QUERIES[name](spark, str(DATA)).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    plain = lambda v: None if pd.isna(v) else v if isinstance(v, str) else int(v)
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f[sorted(f.columns)].itertuples(index=False)), key=str)
    assert rows(ours) == rows(theirs)
