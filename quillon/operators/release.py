"""Immutable outputs: content-addressed articles, curated releases and deterministic backups."""

from __future__ import annotations

import contextlib
import gzip
import hashlib
import io
import json
import os
import re
import shutil
import tarfile
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import scratch
from ..functions.text import canonical_document
from . import curation, integrity

LORE = "internal lore"
MANIFEST = "backup-manifest.json"
PREFIX = "quillon"
HEAD, DIGEST, SIDECAR = "[0-9a-f]{40}", "[0-9a-f]{64}", "([0-9a-f]{64})  (\\S+)\n?"


def fingerprint(articles: list[tuple[str, str, list[tuple[str, str, list[str], int]]]]) -> str:
    """SHA-256 over (title, article id, passages) in order of folded title and id; articles without passages count."""
    ordered = sorted(articles, key=lambda a: (a[0].casefold(), a[1]))
    return hashlib.sha256(json.dumps([[t, i, [list(p) for p in ps]] for t, i, ps in ordered], ensure_ascii=False).encode()).hexdigest()


def write_once(path: Path, content: bytes) -> bool:
    """Whether the file is new. The same bytes again are no change; others raise FileExistsError."""
    if path.exists():
        if path.read_bytes() == content:
            return False
        raise FileExistsError(f"{path} holds something else")
    stage = path.with_name(f".{path.name}.{os.getpid()}")
    stage.write_bytes(content)
    os.replace(stage, path)
    return True


def _commits(spark: SparkSession, folder: str) -> list[dict]:
    """The commits of a table of articles in order; each names one folder of data."""
    out: list[dict] = []
    while (raw := scratch.read_bytes(spark, f"{folder}/_commits/{len(out) + 1:020d}.json")) is not None:
        out.append(json.loads(raw))
    return out


def _committed(spark: SparkSession, folder: str, commits: list[dict], shape: StructType) -> DataFrame:
    paths = [f"{folder}/{c['data']}" for c in commits]
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)


def read_articles(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The articles that are committed at folder, or were at a version (how many commits there were)."""
    commits = _commits(spark, folder)
    if version is not None and not 0 <= version <= len(commits):
        raise ValueError(f"{folder} has no version {version}")
    return _committed(spark, folder, commits[:version], StructType.fromDDL("article_artifact_id string, document string"))


def write_articles(articles: DataFrame, folder: str) -> int:
    """Add articles (article_artifact_id, document) that the table at folder lacks; the version of the table then.

    An id with another document, in the table or among the given ones, is an error and nothing is added. Repeated
    rows count once. Data is written aside and becomes part of the table by a commit, a small file whose number can
    be put once only. A writer that finds its number taken looks at what the others committed, drops what they
    already have, and tries the next number, so of writers with different documents for an id one succeeds, and
    a writer that tries again after a failure adds nothing twice.
    """
    spark = articles.sparkSession
    rows = articles.select(F.col("article_artifact_id").cast("string").alias("article_artifact_id"), F.col("document").cast("string").alias("document"))
    shape = rows.schema
    # Digests decide what is equal, so that a document that many rows repeat is not moved for each of them.
    rows = rows.withColumn("digest_", F.sha2("document", 256)).dropDuplicates(["article_artifact_id", "digest_"])
    rows = scratch.table(rows, "new_articles")
    clash = rows.groupBy("article_artifact_id").agg(F.count("*").alias("n")).where("n > 1").select("article_artifact_id").first()
    if clash:
        raise FileExistsError(f"{clash[0]} comes with several documents")
    known = 0
    while True:
        commits = _commits(spark, folder)
        if commits[known:]:
            old = _committed(spark, folder, commits[known:], shape).select("article_artifact_id", F.sha2("document", 256).alias("old_"))
            both = scratch.table(rows.join(old, "article_artifact_id", "left"), "new_articles")
            clash = both.where("old_ is not null and not (old_ <=> digest_)").select("article_artifact_id").first()
            if clash:
                raise FileExistsError(f"{clash[0]} holds something else")
            rows = both.where("old_ is null").drop("old_")
        known = len(commits)
        if rows.isEmpty():
            return known
        data = f"data-{uuid.uuid4().hex}"
        rows.select("article_artifact_id", "document").write.parquet(f"{folder}/{data}")
        if scratch.put_if_absent(spark, f"{folder}/_commits/{known + 1:020d}.json", json.dumps({"data": data}).encode()):
            return known + 1
        scratch.remove(spark, f"{folder}/{data}")


def selection(passages: DataFrame, events: DataFrame) -> DataFrame:
    """(article_artifact_id, lore_passage_ids): articles with lore, and their lore passages in source order.

    passages: article_artifact_id, passage_id, source_pos. Raises when events name unknown passages, or
    when passages are deferred or undecided.
    """
    decided = curation.effective(events)
    unknown = decided.join(passages, "passage_id", "left_anti").select("passage_id").first()
    if unknown:
        raise ValueError(f"decision on unknown passage {unknown[0]}")
    open_ = passages.join(decided.select("passage_id", "action"), "passage_id", "left").agg(F.count_if(F.col("action").isNull()).alias("undecided"), F.count_if(F.col("action") == "defer").alias("deferred")).first()
    if open_["undecided"] or open_["deferred"]:
        raise ValueError(f"curation is incomplete: {open_['undecided']} undecided, {open_['deferred']} deferred")
    lore = passages.join(decided.where(F.col("classification") == LORE).select("passage_id"), "passage_id", "left_semi")
    return lore.groupBy("article_artifact_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_pos", "passage_id"))), lambda x: x["passage_id"]).alias("lore_passage_ids"))


def digest(path: Path) -> str:
    with path.open("rb") as f:
        return _hashed(f)[1]


@contextlib.contextmanager
def staged(copies: dict[str, Path]) -> Iterator[Path]:
    """A folder of copies of files, for as long as it is looked at."""
    with tempfile.TemporaryDirectory() as name:
        for own, path in copies.items():
            shutil.copyfile(path, Path(name, own))
        yield Path(name)


def publish(folder: Path, files: dict[str, bytes], copies: dict[str, Path] | None = None) -> None:
    """All files, and copies of others, under a new folder, in one rename; FileExistsError if it is there or appears meanwhile."""
    if folder.exists():
        raise FileExistsError(folder)
    folder.parent.mkdir(parents=True, exist_ok=True)
    stage = Path(tempfile.mkdtemp(prefix=f".{folder.name}.", dir=folder.parent))
    try:
        for name, content in files.items():
            (stage / name).parent.mkdir(parents=True, exist_ok=True)
            (stage / name).write_bytes(content)
        for name, path in (copies or {}).items():
            (stage / name).parent.mkdir(parents=True, exist_ok=True)
            shutil.copyfile(path, stage / name)
        try:
            os.rename(stage, folder)
        except OSError as error:
            raise FileExistsError(folder) from error
    finally:
        shutil.rmtree(stage, ignore_errors=True)


def release_manifest(release_id: str, source: dict, articles: list[dict], corpus: list[dict], curation_info: dict) -> str:
    """The canonical manifest of a release; articles are those of the selection."""
    ordered = sorted(articles, key=lambda a: (a["canonical_title"].casefold(), a["article_artifact_id"]))
    return canonical_document({
        "release_id": release_id, "schema_version": 2, "selection_policy": "all lore-bearing articles", "source_snapshot": source, "curation": curation_info,
        "counts": {"articles": len(ordered), "lore_passages": sum(len(a["lore_passage_ids"]) for a in ordered)},
        "articles": ordered, "corpus_articles": sorted(corpus, key=lambda a: a["article_artifact_id"]),
    })


def validate_release(expected: str, found: str) -> None:
    """A manifest must equal the one rebuilt from its parts, as a document and byte for byte."""
    if json.loads(found) != json.loads(expected):
        raise ValueError("manifest does not follow from the release's parts")
    if found != expected:
        raise ValueError("manifest is not in canonical form")


def _hashed(stream) -> tuple[int, str]:
    size, digest = 0, hashlib.sha256()
    while block := stream.read(1 << 20):
        size += len(block)
        digest.update(block)
    return size, digest.hexdigest()


def _member(path: str, size: int) -> tarfile.TarInfo:
    info = tarfile.TarInfo(path)
    info.size, info.mode = size, 0o644  # owner, group and time stay 0
    return info


def archive_name(label: str, prefix: str = PREFIX) -> str:
    return f"{prefix}-{label}.tar.gz"


def write_backup(folder: Path, label: str, git_head: str, source: dict, members: dict[str, Path], prefix: str = PREFIX) -> Path:
    """The archive of members (path in it -> file) and its sidecar, both or neither; FileExistsError over either.

    The bytes follow from the members alone, whenever and by whomever it is made. Members stream through.
    """
    if bad := [*integrity.label_faults(label), *(f for p in members for f in integrity.path_faults(p))]:
        raise ValueError(bad[0])
    if not re.fullmatch(HEAD, git_head):
        raise ValueError("no commit of 40 hexadecimal digits")
    target = folder / archive_name(label, prefix)
    sidecar = target.with_name(target.name + ".sha256")
    if target.exists() or sidecar.exists():
        raise FileExistsError(target)
    folder.mkdir(parents=True, exist_ok=True)
    listed = []
    for path in sorted(members):
        with members[path].open("rb") as f:
            listed.append(dict(zip(("size_bytes", "sha256"), _hashed(f), strict=True), path=path))
    manifest = canonical_document({"schema_version": 1, "label": label, "git_head": git_head, "source_snapshot": source, "members": listed}).encode()
    part, note = target.with_name(target.name + ".part"), sidecar.with_name(sidecar.name + ".part")
    try:
        with part.open("wb") as raw, gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0, filename="") as packed, tarfile.open(fileobj=packed, mode="w|", format=tarfile.GNU_FORMAT) as tar:
            sizes = {x["path"]: x["size_bytes"] for x in listed}
            for path in sorted([*members, MANIFEST]):
                with io.BytesIO(manifest) if path == MANIFEST else members[path].open("rb") as f:
                    tar.addfile(_member(path, len(manifest) if path == MANIFEST else sizes[path]), f)
        with part.open("rb") as f:
            note.write_text(f"{_hashed(f)[1]}  {target.name}\n")
        verify_archive(part, label_of=target.name, prefix=prefix)
        os.link(part, target)
        try:
            os.link(note, sidecar)
        except OSError:
            target.unlink()
            raise
    finally:
        part.unlink(missing_ok=True)
        note.unlink(missing_ok=True)
    return target


def members_of(archives: DataFrame) -> DataFrame:
    """(archive, position, path, size_bytes, sha256, mode, mtime, uid, gid, content) of tar.gz files read as binaryFile."""
    import pandas as pd

    schema = "archive string, position int, path string, size_bytes long, sha256 string, mode int, mtime long, uid int, gid int, content binary"

    def run(parts):
        for part in parts:
            rows = []
            for name, content in zip(part.path, part.content, strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    for i, m in enumerate(tar):
                        raw = tar.extractfile(m).read() if m.isfile() else b""
                        rows.append((name, i, m.name, len(raw), hashlib.sha256(raw).hexdigest(), m.mode, int(m.mtime), m.uid, m.gid, raw))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return archives.select("path", "content").mapInPandas(run, schema)


def sidecar_parts(text: str) -> tuple[str, str]:
    """(digest, file name) of a sidecar; ValueError for any other form."""
    found = re.fullmatch(SIDECAR, text)
    if not found:
        raise ValueError("sidecar is no line of a digest and a name")
    return found[1], found[2]


def manifest_faults(manifest: object) -> list[str]:
    """What is wrong with a backup's manifest, first things first."""
    if not isinstance(manifest, dict):
        return ["manifest is no object"]
    out = [] if type(manifest.get("schema_version")) is int and manifest["schema_version"] == 1 else ["manifest has another version"]
    out += integrity.label_faults(manifest.get("label"))
    out += [] if isinstance(manifest.get("git_head"), str) and re.fullmatch(HEAD, manifest["git_head"]) else ["manifest names no commit"]
    out += [] if isinstance(manifest.get("source_snapshot"), dict) else ["manifest has no source snapshot"]
    members = manifest.get("members")
    if not isinstance(members, list) or not members or not all(isinstance(m, dict) for m in members):
        return [*out, "manifest lists no members"]
    for m in members:
        good = isinstance(m.get("path"), str) and type(m.get("size_bytes")) is int and m["size_bytes"] >= 0 and isinstance(m.get("sha256"), str) and re.fullmatch(DIGEST, m["sha256"])
        out += integrity.path_faults(m["path"]) if good else [f"manifest has a bad member {m.get('path')!r}"]
    paths = [m.get("path") for m in members]
    out += ["manifest lists a member twice"] * (len(paths) != len(set(map(str, paths)))) + ["manifest lists itself"] * (MANIFEST in paths)
    return out + [f"manifest lacks {p}" for p in integrity.REQUIRED_PATHS if p not in paths]


def verify_archive(archive: Path, label_of: str, prefix: str = PREFIX) -> dict:
    """The manifest of an archive whose members, order and digests are right; else ValueError. Members stream through."""
    held: dict[str, tuple[int, str]] = {}
    names: list[str] = []
    manifest = b""
    with tarfile.open(archive, mode="r|gz") as tar:
        for m in tar:
            names.append(m.name)
            if faults := integrity.path_faults(m.name, MANIFEST):
                raise ValueError(faults[0])
            if not m.isfile() or (m.uid, m.gid, m.mtime, m.mode & 0o7777, m.uname, m.gname) != (0, 0, 0, 0o644, "", ""):
                raise ValueError(f"member {m.name} is not normalised")
            if m.name == MANIFEST:
                manifest = tar.extractfile(m).read()
            else:
                held[m.name] = _hashed(tar.extractfile(m))
    if names != sorted(set(names)):
        raise ValueError("members are repeated or out of order")
    try:
        document = json.loads(manifest)
    except ValueError as error:
        raise ValueError("manifest is no JSON") from error
    if faults := manifest_faults(document):
        raise ValueError(faults[0])
    if archive_name(document["label"], prefix) != label_of:
        raise ValueError("archive is not named after its label")
    if missing := [p for p in (*integrity.REQUIRED_PATHS, *integrity.REQUIRED_FOLDERS) if not any(n == p or (p.endswith("/") and n.startswith(p)) for n in held)]:
        raise ValueError(f"archive lacks {missing[0]}")
    listed = [(m["path"], (m["size_bytes"], m["sha256"])) for m in document["members"]]
    if listed != list(held.items()):
        raise ValueError("members do not match the manifest")
    return document


def verify_backup(archive: Path, prefix: str = PREFIX) -> dict:
    """The manifest of an archive that its sidecar beside it and its own members bear out; else ValueError."""
    sidecar = archive.with_name(archive.name + ".sha256")
    if not archive.is_file() or not sidecar.is_file():
        raise ValueError(f"{archive} or its sidecar is missing")
    digest, name = sidecar_parts(sidecar.read_text())
    with archive.open("rb") as f:
        if name != archive.name or _hashed(f)[1] != digest:
            raise ValueError("sidecar does not match")
    return verify_archive(archive, archive.name, prefix)


def inventory_changes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """What of a manifest (path, size_bytes, sha256) is missing or changed on disk; other files don't matter."""
    return integrity.compared(manifest, files).where("state <> 'unexpected'")
