"""The corpus lifecycle, from candidates to verified backups: operators joined to flows over files."""

from __future__ import annotations

import json
import re
import subprocess
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .functions import text as T
from .operators import checks, curation, extract, integrity, release, resolve
from .sources import articles, dump, dump_index, snapshot, statefile, web
from .sources.progress import EVERY, Progress

LABELS = tuple(curation.CLASSIFICATIONS.values())


def stamp() -> str:
    return datetime.now(UTC).strftime("%Y%m%dT%H%M%S%fZ")


def discover(spark: SparkSession, output: Path, categories: list[str], nominations: list[str], most: int, listing: web.Listing | None, at: datetime) -> int:
    """Write the candidates of categories and nominations as a new discovery file; how many there are.

    The bounds keep what is listed to 20 x 500 rows; a category is asked for `most` pages.
    """
    if not categories and not nominations:
        raise ValueError("a category or a nomination is needed")
    if not 1 <= most <= 500 or len(categories) > 20:
        raise ValueError("at most 500 candidates of at most 20 categories")
    if categories and listing is None:
        raise ValueError("categories need a listing")
    pages = [(c, i, n, *page) for i, c in enumerate(categories) for n, page in enumerate(listing.articles(c if c.startswith("Category:") else f"Category:{c}", most), 1)]
    listed = spark.createDataFrame(pages, "category string, category_ord int, page_ord int, page_id long, title string")
    named = spark.createDataFrame(list(enumerate(nominations)), "nomination_ord int, title string")
    found = resolve.discover(listed, named, most).orderBy("ord").collect()  # at most `most`
    records = [{k: v for k, v in r.asDict().items() if k != "ord"} | {"discovery_timestamp": at.isoformat()} for r in found]
    articles.write_new(output, {"schema_version": 1, "records": records})
    return len(records)


def acquire(spark: SparkSession, discoveries: Path, dump_path: Path, data: Path, retrieved_at: datetime, progress: Callable[[str], None] = lambda _: None, every: int = EVERY) -> dict:
    """Articles of the candidates, written once each under data/articles, and the result as written.

    The dump is checked to its end before anything is written.
    """
    if retrieved_at.tzinfo is None:
        raise ValueError("the retrieval time needs a zone")
    if dump_path.name != checks.PINNED["filename"]:
        raise ValueError(f"the dump has to be named {checks.PINNED['filename']}")
    fresh = checks.PINNED | {"retrieval_timestamp": retrieved_at.astimezone(UTC).isoformat()}
    source, new = articles.source_snapshot(data / "source/source-snapshot.json", fresh)
    candidates = articles.discoveries(spark, str(discoveries))
    if candidates.isEmpty():
        raise ValueError("no candidates")
    progress("checking the dump")
    scan = Progress(spark, lambda step, n: progress(f"{n} records read") if n else None, every)
    dump.check(spark, str(dump_path), source["wiki_database"], scan)
    progress(f"{scan.final['pages']} pages, {scan.final['redirects']} redirects")
    progress("resolving candidates")
    if dump_path.suffix == ".bz2":  # one pass for a directory of all pages, then the blocks of those that are wanted
        directory = dump_index.write(spark, [str(dump_path.resolve())], scratch.new_path(spark, "directory"))
        selected, failures = resolve.acquired(candidates, directory, lambda wanted: dump_index.fetch(wanted).drop("bytes_read"))
    else:
        selected, failures = resolve.acquired(candidates, dump.pages(spark, str(dump_path)))
    rows = extract.articles(selected, source)
    documents = extract.documents(rows).join(selected.select(extract.article_ids(F.lit(source["dump_run"]), "page_id", "revision_id").alias("article_artifact_id"), "observed_page_title", "first_order"), "article_artifact_id")
    written = documents.orderBy("first_order").collect()  # at most 500 candidates
    for r in written:
        path = data / "articles" / f"{r['article_artifact_id']}.json"
        path.parent.mkdir(parents=True, exist_ok=True)
        release.write_once(path, r["document"].encode())
    if new:
        articles.write_new(data / "source/source-snapshot.json", source)
    lost = failures.orderBy("place").drop("place").collect()
    wins = [{"candidate_title": r["observed_page_title"], "article_artifact_id": r["article_artifact_id"]} for r in written]
    resolvable = bool(wins) or any(r["reason"] == resolve.NO_TARGET[1] or r["reason"].startswith("namespace") for r in lost)
    result = {"schema_version": 1, "source_snapshot": source, "scan_passes": 2 if resolvable else 1, "successes": wins, "failures": [r.asDict() for r in lost]}
    articles.write_result(data, "acquisition-result", result, stamp)
    return result


def corpus(spark: SparkSession, folder: Path) -> tuple[DataFrame, DataFrame, str]:
    """(files, passages in order, fingerprint) of a folder of articles; ValueError for the first rule that one breaks.

    passages: article_ord and source_pos give the order: articles by folded title and id, passages as they stand.
    """
    if not folder.is_dir() or not any(folder.glob("*.json")):
        raise ValueError(f"no articles in {folder}")
    files = articles.json_files(spark, str(folder), articles.ARTICLE).cache()
    rows = articles.passages(files)
    checks.raise_first(checks.curation_rules(files, rows), "articles")
    heads = files.select(F.col("doc.article_artifact_id").alias("owner_id"), F.col("doc.canonical_title").alias("canonical_title"), T.casefold("doc.canonical_title").alias("folded"))
    lists = rows.groupBy("owner_id").agg(F.array_sort(F.collect_list(F.struct("source_pos", "passage_id", "normalized_text", "heading_path", "paragraph_ordinal"))).alias("passages"))
    # A fingerprint is of one text of all articles: curated corpora are read by people, passage by passage.
    whole = heads.join(lists, "owner_id", "left").orderBy("folded", "owner_id").collect()
    mark = release.fingerprint([(r["canonical_title"], r["owner_id"], [tuple(p)[1:] for p in r["passages"] or []]) for r in whole])
    order = spark.createDataFrame([(r["owner_id"], i) for i, r in enumerate(whole)], "owner_id string, article_ord int")
    return files, rows.join(order, "owner_id"), mark


def manifest(spark: SparkSession, release_id: str, folder: Path, curated: Path) -> dict:
    """The manifest that a release of these articles and decisions has; ValueError where they make none."""
    if not re.match(integrity.RELEASE_ID.replace("\\z", "\\Z"), release_id):
        raise ValueError(f"bad release id {release_id!r}")
    files, rows, mark = corpus(spark, folder)
    metadata, events, _ = snapshot.load(spark, curated, LABELS)
    if metadata["corpus_fingerprint"] != mark:
        raise ValueError("the decisions are on another corpus")
    checks.raise_first(checks.release_rules(rows.select("passage_id", "article_artifact_id"), events, files), "release")
    lore = release.selection(rows.select("article_artifact_id", "passage_id", "source_pos"), events)
    heads = files.select("file", "sha256", "doc.article_artifact_id", "doc.canonical_title", "doc.page_id", "doc.revision_id", "doc.revision_timestamp", F.col("doc.source_snapshot").alias("source"), "body")
    every = heads.join(lore, "article_artifact_id", "left").orderBy("file").collect()
    chosen = [r for r in every if r["lore_passage_ids"]]
    if not chosen:
        raise ValueError("a release without lore")
    listed = [{"article_artifact_id": r["article_artifact_id"], "artifact_sha256": r["sha256"], **{k: r[k] for k in ("canonical_title", "lore_passage_ids", "page_id", "revision_id", "revision_timestamp")}} for r in chosen]
    inventory = [{"article_artifact_id": r["article_artifact_id"], "artifact_filename": r["file"], "artifact_sha256": r["sha256"]} for r in every]
    about = {"corpus_fingerprint": mark, "rubric_id": metadata["rubric_id"], "snapshot_sha256": release.digest(curated)}
    return json.loads(release.release_manifest(release_id, json.loads(every[0]["body"])["source_snapshot"], listed, inventory, about))


def create_release(spark: SparkSession, release_id: str, folder: Path, curated: Path, output: Path) -> dict:
    """A folder with the manifest, its articles and its decisions, made whole or not at all."""
    if output.parent.exists():
        raise FileExistsError(f"{output.parent} is a retained release")
    document = manifest(spark, release_id, folder, curated)
    files = {output.name: T.canonical_document(document).encode(), "curation.jsonl": curated.read_bytes()}
    release.publish(output.parent, files, {f"articles/{a['artifact_filename']}": folder / a["artifact_filename"] for a in document["corpus_articles"]})
    return document


def validate_release(spark: SparkSession, path: Path, folder: Path, curated: Path) -> dict:
    """The manifest at path, if it follows from its inventory's articles and from the decisions, byte for byte."""
    text = path.read_text(encoding="utf-8")
    document = checks.parsed(text)
    listed = document.get("corpus_articles") if isinstance(document, dict) else None
    if not isinstance(listed, list) or not listed or document.get("schema_version") != 2 or not isinstance(document.get("release_id"), str) or not all(isinstance(x, dict) for x in listed):
        raise ValueError("no release manifest")
    names = ("artifact_filename", "article_artifact_id", "artifact_sha256")
    inventory = spark.createDataFrame([tuple(x.get(n) if isinstance(x.get(n), str) else None for n in names) for x in listed], ", ".join(f"{n} string" for n in names))
    found = articles.json_files(spark, str(folder), "x string").select("file", "sha256")
    checks.raise_first(checks.inventory_rules(inventory, found), "inventory")
    with release.staged({x["artifact_filename"]: folder / x["artifact_filename"] for x in listed}) as own:  # files that no inventory names don't matter
        expected = manifest(spark, document["release_id"], own, curated)
    release.validate_release(T.canonical_document(expected), text)
    return document


def git_head(repository: Path, dirty: bool) -> str:
    """The commit of a repository; ValueError where there is none, or changes that aren't committed."""

    def said(*arguments: str) -> str:
        done = subprocess.run(["git", *arguments], cwd=repository, capture_output=True, text=True)
        if done.returncode:
            raise ValueError(f"git {arguments[0]}: {done.stderr.strip()}")
        return done.stdout.strip()

    head = said("rev-parse", "HEAD")
    if not re.fullmatch(release.HEAD, head):
        raise ValueError("git names no commit")
    if not dirty and said("status", "--porcelain"):
        raise ValueError("the working tree has changes")
    return head


def _real(path: Path, folder: bool = False) -> Path:
    if path.is_symlink() or not (path.is_dir() if folder else path.is_file()):
        raise ValueError(f"{path} is no real {'folder' if folder else 'file'}")
    return path


def payload(spark: SparkSession, repository: Path) -> tuple[dict, dict[str, Path]]:
    """(source, members) of a repository's data: what a backup holds, once every rule is met."""
    data = _real(repository / "data", True)
    for part in ("corpus", "corpus/source", "corpus/articles", "discovery"):
        _real(data / part, True)
    fixed = [_real(repository / p) for p in integrity.REQUIRED_PATHS]
    source, result = (checks.parsed(p.read_text(encoding="utf-8")) for p in fixed)
    if not isinstance(source, dict) or set(source) != {*checks.PINNED, "retrieval_timestamp"} or not all(isinstance(v, str) for v in source.values()):
        raise ValueError("no source snapshot")
    checks.raise_first(checks.source_rules(spark.createDataFrame([(source,)], f"s {articles.SOURCE}"), F.lit("source-snapshot.json"), "s"), "source")
    found, notes = ([_real(p) for p in sorted((data / d).glob("*.json"))] for d in ("corpus/articles", "discovery"))
    faults = checks.result_faults(result, source) + ["no articles"] * (not found) + ["no discoveries"] * (not notes)
    faults += [f"{p.name}: {x}" for p in notes for x in checks.discovery_faults(checks.parsed(p.read_text(encoding="utf-8")))]
    if faults:
        raise ValueError(faults[0])
    files = articles.json_files(spark, str(data / "corpus/articles"), articles.ARTICLE)
    checks.raise_first(checks.backup_rules(files, articles.passages(files), source), "articles")
    declared = spark.createDataFrame([(x["article_artifact_id"],) for x in result["successes"]], "id string")
    odd = integrity.both_ways(files.select(F.col("doc.article_artifact_id").alias("id")), declared, "id").orderBy("side", "id").first()
    if odd:
        raise ValueError(f"article {odd['id']} is {'not declared' if odd['side'] == 'left only' else 'missing'}")
    return source, {p.relative_to(repository).as_posix(): p for p in (*notes, *fixed, *found)}


def create_backup(spark: SparkSession, repository: Path, label: str, folder: Path, dirty: bool = False) -> Path:
    if faults := integrity.label_faults(label):
        raise ValueError(faults[0])
    head = git_head(repository, dirty)
    source, members = payload(spark, repository)
    return release.write_backup(folder, label, head, source, members)


def load_curation(lines: Iterable[str], state: Path) -> None:
    statefile.load(state, list(lines), LABELS)
