"""Backups in parts: the same archive as one file, and nothing that was changed passes."""

from __future__ import annotations

import gzip
from pathlib import Path

import pytest

from quillon.operators import backup_parts, integrity, release

ODD = {"data/discovery/one.json": b"", "data/corpus/articles/" + "long" * 60 + ".json": b"x" * 512, 'data/corpus/articles/"ü".json': b"y" * 70_000}


def test_one_archive_in_parts(spark, tmp_path, monkeypatch):
    members = ODD | dict.fromkeys(integrity.REQUIRED_PATHS, b"{}") | {f"data/corpus/articles/{i}.json": b"%d" % i for i in range(300)}
    monkeypatch.setattr(backup_parts, "_write_rows", lambda rows, *rest, own=backup_parts._write_rows: own(rows.coalesce(1), *rest))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that members and manifest have several parts
    try:
        folder = Path(tmp_path, "parts")
        backup_parts.write(spark.createDataFrame(list(members.items()), "path string, content binary"), f"file://{folder}", "v1", "0" * 40, {"run": "r"})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    names = [line.split("  ")[1] for line in (folder / "quillon-v1.tar.gz.sha256").read_text().splitlines()]
    assert sum(n.startswith("members-") for n in names) > 1 and sum(n.startswith("manifest-") for n in names) > 1
    files = {}
    for i, (path, content) in enumerate(members.items()):
        files[path] = tmp_path / f"m{i}"
        files[path].write_bytes(content)
    whole = release.write_backup(tmp_path / "one", "v1", "0" * 40, {"run": "r"}, files)
    joined = tmp_path / whole.name
    joined.write_bytes(b"".join((folder / n).read_bytes() for n in names))
    assert gzip.decompress(joined.read_bytes()) == gzip.decompress(whole.read_bytes())
    manifest, found = backup_parts.read(spark, f"file://{folder}", "v1")
    assert manifest["source_snapshot"] == {"run": "r"}
    assert [r[0] for r in found.orderBy("part", "position").select("path").collect()] == sorted(members)
    changed = folder / next(n for n in names if n.startswith("members-"))
    changed.write_bytes(gzip.compress(gzip.decompress(changed.read_bytes()), 1, mtime=0))
    with pytest.raises(ValueError, match="sidecar"):
        backup_parts.read(spark, f"file://{folder}", "v1")
    with pytest.raises(ValueError, match="no member"):
        backup_parts.write(spark.createDataFrame([("data/x", b"")], "path string, content binary"), f"file://{tmp_path}/bad", "v1", "0" * 40, {})
