"""Queries on tables made for a test, against their SQL."""

from __future__ import annotations

import pandas as pd
import pytest
from test_queries import ORACLES, QUERIES, plain

duckdb = pytest.importorskip("duckdb")


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, frame in tables.items():
        frame.to_parquet(folder / f"{table}.parquet", index=False)
        con.sql(f"create view {table} as from '{folder}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, str(folder)).toPandas(), con.sql(ORACLES[name]).df()
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f[sorted(f.columns)].itertuples(index=False)), key=str)
    assert rows(ours) == rows(theirs)
    return ours


def test_ampersands_of_no_entity(spark, tmp_path):
    html = ["<h1>the&amp;&amp;&amp</h1><p>one &copy; two &lt three &#38; four &amp;copy; five &ampersand; six</p>", "<h1>a&amp</h1><p>x</p><h1>a&amp;</h1><p>y &amp;amp; z &nbsp; &#39;&quot;</p>"]
    assert len(same_as_sql(spark, tmp_path, "extraction_passages", pages=pd.DataFrame({"page_id": [1, 2], "url": "u", "html": html}))) == 3


def test_backup_keeps_to_a_task_each(spark, tmp_path):
    pages = pd.DataFrame({"page_id": range(40), "url": "u", "html": [None if i == 7 else f"<p>{i}</p>" for i in range(40)]})
    assert len(same_as_sql(spark, tmp_path, "backup_members", pages=pages)) == 40
