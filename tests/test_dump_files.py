"""A dump in several files is checked and scanned in their order, whichever is read first."""

from __future__ import annotations

import pandas as pd

from quillon import scratch
from quillon.plans import QUERIES
from quillon.sources import dump

PAGE = "<page><title>T{0}</title><ns>0</ns><id>{0}</id><revision><id>{0}</id><timestamp>2026-06-30T00:00:00Z</timestamp><text>{1}</text></revision></page>"


def test_small_file_with_the_name_first(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "part-0").write_text("<mediawiki><siteinfo><dbname>pages</dbname></siteinfo>")
    (tmp_path / "d" / "part-1").write_text("".join(PAGE.format(i, "x" * 5000) for i in range(50)) + "</mediawiki>")
    assert [r[0] for r in dump.pages(spark, str(tmp_path / "d"), "pages").orderBy("scan_pos").select("page_id").collect()] == list(range(50))


def test_no_task_writes_the_whole_dump(spark, tmp_path, monkeypatch):
    pd.DataFrame({"page_id": range(60), "url": "u", "html": "<p>x</p>"}).to_parquet(tmp_path / "pages.parquet", index=False)
    paths = []
    monkeypatch.setattr(scratch, "new_path", lambda s, name, own=scratch.new_path: paths.append(own(s, name)) or paths[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = QUERIES["dump_scan"](spark, str(tmp_path)).orderBy("page_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["place"] for r in found] == list(range(1, len(found) + 1))
    assert len(spark.read.text(next(p for p in paths if "/dump-" in p)).inputFiles()) > 1
