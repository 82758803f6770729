"""Backups of any size: an archive in parts that are written, read and checked by as many tasks.

Parts are gzip members, so that one after another (`cat`, in the order of the sidecar) they are the tar.gz of one archive:
its manifest first, then its members in order. Its bytes without compression are those of release.write_backup, whatever the parts.
The sidecar has a line with digest and name for each part and comes last: a backup that broke off has none.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions.text import canonical_document
from . import integrity, release

PART_BYTES = 64 << 20  # packed bytes from which on a part takes no more members
BLOCK = 512
_WRITTEN = "part string, digest string, bytes long, path string, size_bytes long, sha256 string"
_FOUND = "part int, position int, path string, size_bytes long, sha256 string, mode int, mtime long, uid int, gid int, fault string"
_GAP = ",\n"  # between the entries of a manifest


class _Part:
    """One gzip member in a file of its own; its name is new in every attempt of a task."""

    def __init__(self, folder: str, kind: str):
        fs, root = scratch.filesystem(folder)
        fs.create_dir(root, recursive=True)
        self.name, self.hash, self.packed, self.size = f"{kind}-{uuid.uuid4().hex}.gz", hashlib.sha256(), 0, 0
        self.raw = fs.open_output_stream(f"{root}/{self.name}", compression=None)
        self.zip = gzip.GzipFile(fileobj=self, mode="wb", compresslevel=6, mtime=0, filename="")

    def write(self, packed) -> int:
        self.hash.update(packed)
        self.packed += len(packed)
        self.raw.write(packed)
        return len(packed)

    def flush(self) -> None:
        pass

    def add(self, content: bytes) -> None:
        self.zip.write(content)
        self.size += len(content)

    def close(self) -> dict:
        self.zip.close()
        self.raw.close()
        return {"part": self.name, "digest": self.hash.hexdigest(), "bytes": self.size}


class _Tap(io.RawIOBase):
    """A stream whose bytes are hashed as they are read."""

    def __init__(self, raw):
        self.raw, self.hash = raw, hashlib.sha256()

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self.raw.read(len(buffer))
        buffer[: len(got)] = got
        self.hash.update(got)
        return len(got)


def _header(path: str, size: int) -> bytes:
    return release._member(path, size).tobuf(tarfile.GNU_FORMAT)


def _padding(size: int, unit: int = BLOCK) -> bytes:
    return b"\0" * (-size % unit)


def _entry(path: str, size: int, digest: str) -> str:
    """A member as a manifest lists it."""
    own = canonical_document([{"path": path, "size_bytes": size, "sha256": digest}])
    return "\n".join("  " + line for line in own.split("\n")[1:-2])


def _around(label: str, git_head: str, source: dict) -> tuple[str, str]:
    """What stands before and after the entries in a manifest."""
    text = canonical_document({"schema_version": 1, "label": label, "git_head": git_head, "source_snapshot": source, "members": [0]})
    before, after = text.split('"members": [\n    0\n  ]', 1)
    return before + '"members": [\n', "\n  ]" + after


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]))


def _write_rows(rows: DataFrame, folder: str, kind: str, pieces) -> DataFrame:
    """rows in parts; pieces(row) gives the bytes of a row and what is told of it. A written table of _WRITTEN: a row for each part, without path, and for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                part = part or _Part(folder, kind)
                content, told = pieces(row)
                for piece in content:
                    part.add(piece)
                out.append({"part": part.name} | told)
                if part.packed >= PART_BYTES:
                    out.append(part.close())
                    part = None
            yield _batch(out, _WRITTEN)
        if part:
            yield _batch([part.close()], _WRITTEN)

    rows = rows.repartitionByRange("path").sortWithinPartitions("path")
    return scratch.table(rows.mapInArrow(run, _WRITTEN), f"backup_{kind}")


def _in_order(written: DataFrame) -> list[tuple]:
    """(digest, part, bytes) in the order of their first rows; a row for each part comes to the driver."""
    of = written.where("path is not null").groupBy("part").agg(F.min("path").alias("first"))
    found = written.where("path is null").select("part", "digest", "bytes").join(of, "part").orderBy("first").collect()
    return [(r["digest"], r["part"], r["bytes"]) for r in found]


def _small(folder: str, kind: str, content: bytes) -> tuple:
    part = _Part(folder, kind)
    part.add(content)
    told = part.close()
    return told["digest"], told["part"], told["bytes"]


def write(members: DataFrame, folder: str, label: str, git_head: str, source: dict) -> None:
    """Write members (path, content binary) as a backup in a folder, check it, and put its sidecar there; FileExistsError over another's."""
    spark = members.sparkSession
    if bad := integrity.label_faults(label):
        raise ValueError(bad[0])
    if not release.re.fullmatch(release.HEAD, git_head):
        raise ValueError("no commit of 40 hexadecimal digits")
    if bad := members.where("path is null").select("path").first() or members.where(~integrity.member_path(F.col("path"))).select("path").first():
        raise ValueError(f"{bad[0]!r} is no member of a backup")
    sidecar = f"{folder}/{release.archive_name(label)}.sha256"
    if scratch.read_bytes(spark, sidecar) is not None:
        raise FileExistsError(sidecar)

    def member(row: dict) -> tuple[list[bytes], dict]:
        path, content = row["path"], row["content"]
        if content is None:
            raise ValueError(f"member {path} has no content")
        return [_header(path, len(content)), content, _padding(len(content))], {"path": path, "size_bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}

    held = _write_rows(members.select("path", F.col("content").cast("binary").alias("content")), folder, "members", member)
    listed = held.where("path is not null").select("path", "size_bytes", "sha256")
    first = listed.agg(F.min("path")).first()[0]

    def entry(row: dict) -> tuple[list[bytes], dict]:
        return [(("" if row["path"] == first else _GAP) + _entry(**{"path": row["path"], "size": row["size_bytes"], "digest": row["sha256"]})).encode()], {"path": row["path"]}

    entries, (before, after) = _in_order(_write_rows(listed, folder, "manifest", entry)), (x.encode() for x in _around(label, git_head, source))
    size = len(before) + sum(n for *_, n in entries) + len(after)
    parts = [_small(folder, "open", _header(release.MANIFEST, size) + before), *entries, _small(folder, "close", after + _padding(size)), *_in_order(held)]
    total = sum(n for *_, n in parts) + 2 * BLOCK
    parts.append(_small(folder, "end", b"\0" * (2 * BLOCK) + _padding(total, tarfile.RECORDSIZE)))
    text = "".join(f"{digest}  {name}\n" for digest, name, _ in parts)
    _verified(spark, folder, label, text)
    if not scratch.put_if_absent(spark, sidecar, text.encode()):
        raise FileExistsError(sidecar)


def read(spark: SparkSession, folder: str, label: str) -> tuple[dict, DataFrame]:
    """(manifest without its members, members) of a backup in parts that its sidecar and manifest bear out; else ValueError.

    Members are (part, position, path, size_bytes, sha256, mode, mtime, uid, gid) in a written table; part and position give their order.
    """
    sidecar = scratch.read_bytes(spark, f"{folder}/{release.archive_name(label)}.sha256")
    if sidecar is None:
        raise ValueError(f"{folder} holds no whole backup {label}")
    return _verified(spark, folder, label, sidecar.decode())


def _members(plain, part: int) -> Iterator[dict]:
    before = ""
    with tarfile.open(fileobj=plain, mode="r|") as tar:
        for i, m in enumerate(tar):
            faults = integrity.path_faults(m.name)
            if not m.isfile() or (m.uid, m.gid, m.mtime, m.mode & 0o7777, m.uname, m.gname) != (0, 0, 0, 0o644, "", ""):
                faults = [*faults, f"member {m.name} is not normalised"]
            if m.name <= before:
                faults = [*faults, "members are repeated or out of order"]
            size, digest = release._hashed(tar.extractfile(m)) if m.isfile() else (0, None)
            yield {"part": part, "position": i, "path": m.name, "size_bytes": size, "sha256": digest, "mode": m.mode, "mtime": int(m.mtime), "uid": m.uid, "gid": m.gid, "fault": faults[0] if faults else None}
            before = m.name


def _entries(plain, part: int) -> Iterator[dict]:
    text = plain.read().decode()
    found = json.loads("[" + text.removeprefix(_GAP) + "]")
    same = text.removeprefix(_GAP) == _GAP.join(_entry(m["path"], m["size_bytes"], m["sha256"]) for m in found)
    rising = all(a["path"] < b["path"] for a, b in zip(found, found[1:], strict=False))
    yield {"part": part, "position": -1, "size_bytes": len(text.encode()), "fault": None if same and rising else "manifest is not in canonical form"}
    for i, m in enumerate(found):
        yield {"part": part, "position": i, **m}


def _verified(spark: SparkSession, folder: str, label: str, sidecar: str) -> tuple[dict, DataFrame]:
    listing = [(i, *release.sidecar_parts(line)) for i, line in enumerate(sidecar.splitlines())]
    kinds = [name.split("-")[0] for _, _, name in listing]
    if [k for i, k in enumerate(kinds) if kinds[:i][-1:] != [k]] != ["open", "manifest", "close", "members", "end"] or any(kinds.count(k) != 1 for k in ("open", "close", "end")):
        raise ValueError("sidecar lists no whole archive")
    small = {}
    for _, digest, name in listing:
        if name.split("-")[0] in ("open", "close", "end"):
            raw = scratch.read_bytes(spark, f"{folder}/{name}")
            if raw is None or hashlib.sha256(raw).hexdigest() != digest:
                raise ValueError(f"part {name} does not match the sidecar")
            small[name.split("-")[0]] = gzip.decompress(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = scratch.filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{row['name']}", compression=None) as raw:
                    tap = _Tap(raw)
                    try:
                        with gzip.GzipFile(fileobj=io.BufferedReader(tap, 1 << 20)) as plain:
                            for found in (_members if row["name"].startswith("members-") else _entries)(plain, row["part"]):
                                rows.append(found)
                                if len(rows) == 4096:
                                    yield _batch(rows, _FOUND)
                                    rows = []
                            while plain.read(1 << 20):
                                pass
                    except (EOFError, OSError, ValueError, KeyError, TypeError, tarfile.TarError) as error:
                        rows.append({"part": row["part"], "position": -2, "fault": f"part {row['name']} can't be read: {error}"})
                    if tap.hash.hexdigest() != row["digest"]:
                        rows.append({"part": row["part"], "position": -2, "fault": f"part {row['name']} does not match the sidecar"})
                yield _batch(rows, _FOUND)

    large = [x for x in listing if x[2].startswith(("members-", "manifest-"))]
    tasks = spark.createDataFrame(large, "part int, digest string, name string").repartition(len(large), "part")
    found = scratch.table(tasks.mapInArrow(run, _FOUND), "backup_found")
    if (fault := found.where("fault is not null").agg(F.min(F.struct("part", "position", "fault"))).first()[0]) is not None:
        raise ValueError(fault["fault"])
    entries, members = (found.where(F.col("part").isin([i for i, _, n in large if n.startswith(k)])) for k in ("manifest-", "members-"))
    for rows in (entries.where("position >= 0"), members):  # a row for each part
        ends = rows.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last")).withColumn("before", F.lag("last").over(Window.orderBy("part")))
        if not ends.where("first <= before").isEmpty():
            raise ValueError("members are repeated or out of order")
    bytes_ = entries.where("position = -1").agg(F.sum("size_bytes")).first()[0]
    before, after = small["open"][BLOCK:], small["close"].rstrip(b"\0")
    try:
        document = json.loads(before + after)
        shape = _around(document["label"], document["git_head"], document["source_snapshot"])
    except (ValueError, KeyError, TypeError) as error:
        raise ValueError("manifest is no JSON") from error
    size = len(before) + bytes_ + len(after)
    if (before.decode(), after.decode()) != shape or small["open"][:BLOCK] != _header(release.MANIFEST, size) or small["close"] != after + _padding(size) or small["end"].strip(b"\0") or len(small["end"]) < 2 * BLOCK:
        raise ValueError("manifest is not in canonical form")
    if faults := release.manifest_faults(document | {"members": [{"path": p, "size_bytes": 0, "sha256": "0" * 64} for p in integrity.REQUIRED_PATHS]}):
        raise ValueError(faults[0])
    if document["label"] != label:
        raise ValueError("archive is not named after its label")
    needed = (*integrity.REQUIRED_PATHS, *integrity.REQUIRED_FOLDERS)
    have = members.agg(*[F.coalesce(F.bool_or(F.startswith("path", F.lit(p)) if p.endswith("/") else F.col("path") == p), F.lit(False)).alias(p) for p in needed]).first()
    if missing := [p for p in needed if not have[p]]:
        raise ValueError(f"archive lacks {missing[0]}")
    if not integrity.compared(entries.where("position >= 0"), members).isEmpty():
        raise ValueError("members do not match the manifest")
    return {k: v for k, v in document.items() if k != "members"}, members.drop("fault")
