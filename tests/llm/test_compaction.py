"""Compaction against the contract in plain Python, the files it leaves, and an interrupted commit."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from quillon.llm import compaction, store

EPOCH = datetime(1970, 1, 1)


def plain(rows, columns):
    """The report without paths. rows: dicts of click_id, arrived_at, value."""
    total, share = len(rows), lambda x: 1 + len(rows) // x
    days = defaultdict(list)
    for r in rows:
        days[None if r["arrived_at"] is None else (r["arrived_at"] - EPOCH).days].append(r)
    out = []
    order = lambda r: (r["arrived_at"] is not None, r["arrived_at"] or EPOCH, r["click_id"] is not None, r["click_id"] or 0)
    for day, own in days.items():
        files = defaultdict(list)
        for r in own:
            h = zlib.crc32(("" if r["click_id"] is None else str(r["click_id"])).encode())
            files[(h // 16) % (1 + len(own) // share(150)), min(h % 4, h // 4 % 4)].append(r)
        groups, bins = [], []
        for (lot, piece), held in sorted(files.items(), key=lambda f: (-len(f[1]), f[0])):
            held = sorted(held, key=order)
            if len(held) >= share(600):
                groups.append([(lot, piece, held)])
                continue
            for b in bins:
                if sum(len(x[2]) for x in b) + len(held) <= share(400):
                    b.append((lot, piece, held))
                    break
            else:
                bins.append([(lot, piece, held)])
        for g in groups + bins:
            joined = [r for _, _, held in g for r in held]
            ids = [r["click_id"] for r in joined if r["click_id"] is not None]
            cents = sum(math.floor(100 * r["value"] + 0.5) for r in joined if r["value"] is not None and math.isfinite(r["value"]))
            digest = hashlib.sha256(",".join("" if r["click_id"] is None else str(r["click_id"]) for r in joined).encode()).hexdigest()
            out.append((day, g[0][0], g[0][1], len(joined), min(ids, default=None), max(ids, default=None), cents, ",".join(f"{a}-{b}" for a, b, _ in g), digest, ",".join(columns), len(g) > 1))
    assert sum(x[3] for x in out) == total
    return out


FIELDS = ("day", "lot", "piece", "n_rows", "min_click_id", "max_click_id", "cents", "sources", "ids_sha256", "columns", "rewritten")


def check(spark, frame):
    folder = store.new_path(spark, "compacted")
    rows = compaction.compacted(frame, folder).collect()
    columns = frame.columns
    found = [r.asDict() for r in frame.select("click_id", "arrived_at", "value").collect()]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r[f] for f in FIELDS) for r in rows), key=key) == sorted(plain(found, columns), key=key)
    place = Path(folder.removeprefix("file://"))
    assert {f"{folder}/{p.name}" for p in place.iterdir() if not p.name.startswith((".", "_"))} == {r["path"] for r in rows} and not [p for p in place.iterdir() if p.is_dir()]
    if rows:
        again = spark.read.parquet(folder)
        assert again.columns == columns and [f.dataType for f in again.schema] == [f.dataType for f in frame.schema]
        text = lambda d: sorted(map(str, d.collect()))
        assert text(again) == text(frame)
    return folder, rows


def test_the_table(spark):
    folder, rows = check(spark, spark.read.parquet("/root/testdata/sf0.01/clicks.parquet"))
    assert any(r["rewritten"] for r in rows) and not all(r["rewritten"] for r in rows)
    for r in rows[:40]:
        times = pq.read_table(r["path"].removeprefix("file://")).column("arrived_at").to_pylist()
        if not r["rewritten"]:
            assert times == sorted(times)


def test_hard_rows(spark):
    draw = random.Random(5)
    start = datetime(1969, 12, 30, 22)
    rows = []
    for _ in range(3000):
        at = None if draw.random() < 0.05 else start + timedelta(seconds=draw.choice([0, 3600 * draw.randrange(300), 86400]))
        rows.append((draw.choice([None, 7, draw.randrange(-5, 10**12)]), at, draw.choice([None, 0.125, -3.005, float("nan"), float("inf"), draw.random() * 1e6]), draw.choice(["a", None]), 1, "x" * draw.randrange(5)))
    frame = spark.createDataFrame(rows, "click_id long, arrived_at timestamp_ntz, value double, quillon_day string, lot int, `a.b` string")
    check(spark, frame)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    check(spark, spark.createDataFrame([(i, datetime(2024, 1, 1 + i % 2), 1.0) for i in range(n)], "click_id long, arrived_at timestamp_ntz, value double"))


def test_files_that_stay_are_not_touched_and_an_interrupted_commit_is_finished(spark, monkeypatch):
    frame = spark.read.parquet("/root/testdata/sf0.001/clicks.parquet")
    folder = store.new_path(spark, "compacted")
    total = compaction.write_pieces(frame, folder)
    place = Path(folder.removeprefix("file://"))
    before = {p.name: p.read_bytes() for p in place.glob("*.parquet")}
    small, full = compaction.share(total, compaction.SMALL), compaction.share(total, compaction.FULL)

    move, calls = compaction.pafs.LocalFileSystem.move, []

    def dies(self, a, b):
        calls.append(b)
        if len(calls) == 4:
            raise OSError("the driver is gone")
        move(self, a, b)

    real = compaction.filesystem

    class Store:
        def __init__(self, inner):
            self.inner = inner

        def __getattr__(self, name):
            return (lambda a, b: dies(self.inner, a, b)) if name == "move" else getattr(self.inner, name)

    recover = compaction.recover
    monkeypatch.setattr(compaction, "recover", lambda f: _with(compaction, "filesystem", lambda uri: (Store(real(uri)[0]), real(uri)[1]), recover, f))
    with pytest.raises(OSError, match="the driver is gone"):
        compaction.compact(spark, folder, small, full)
    monkeypatch.undo()
    assert compaction.recover(folder) and not compaction.recover(folder)
    merged = [p for p in place.glob("*.parquet") if p.name.endswith("-merged.parquet")]
    assert merged and all(before[p.name] == p.read_bytes() for p in place.glob("*.parquet") if p not in merged)
    key = lambda d: sorted(map(str, d.collect()))
    assert key(spark.read.parquet(folder)) == key(frame)
    with pytest.raises(ValueError, match="compacted already"):
        compaction.compact(spark, folder, small, full)


def _with(module, name, value, call, *given):
    old = getattr(module, name)
    setattr(module, name, value)
    try:
        return call(*given)
    finally:
        setattr(module, name, old)
