"""Rules of articles, sources, acquisition results and releases, each as rows (check_id, subject) of what breaks them."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import curation, integrity

# The source that backups are pinned to.
PINNED = {
    "wiki_database": "enwiki", "dump_run": "20260701", "filename": "enwiki-20260701-pages-articles.xml.bz2",
    "source_url": "https://dumps.wikimedia.org/enwiki/20260701/enwiki-20260701-pages-articles.xml.bz2", "extraction_profile": "full non-multistream article dump",
}
STRUCTURE = "prose paragraph"


def filled(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def marked(value: Column) -> Column:
    """More than white space."""
    return F.coalesce(value.rlike("(?U)\\S"), F.lit(False))


def positive(value: Column) -> Column:
    return F.coalesce(value > 0, F.lit(False))


def curation_rules(files: DataFrame, passages: DataFrame) -> DataFrame:
    """What keeps articles from being curated. files: file, broken, doc; passages: as articles.passages gives them.

    An ordinal may be 0 here and a heading path empty.
    """
    one = integrity.violations(files, F.col("file"), {
        "no object of JSON": ~F.col("broken"), "article without id": marked(F.col("doc.article_artifact_id")), "article without title": marked(F.col("doc.canonical_title")),
        "passages are no list": F.col("doc.extracted_passages").isNotNull(),
    })
    each = integrity.violations(passages, F.coalesce("passage_id", "file"), {
        "passage without id": marked(F.col("passage_id")), "passage without text": marked(F.col("normalized_text")), "passage without ordinal": F.col("paragraph_ordinal") >= 0,
        "passage without heading path": F.col("heading_path").isNotNull() & ~F.exists("heading_path", lambda h: h.isNull()), "passage of another article": F.col("article_artifact_id") == F.col("owner_id"),
    })
    twice = integrity.repeated(files.select(F.col("doc.article_artifact_id").alias("subject")).where("subject is not null"), "subject").select(F.lit("article id twice").alias("check_id"), "subject")
    again = integrity.repeated(passages.select(F.col("passage_id").alias("subject")).where("subject is not null"), "subject").select(F.lit("passage id twice").alias("check_id"), "subject")
    return one.unionByName(each).unionByName(twice).unionByName(again)


def source_rules(rows: DataFrame, subject: Column, source: str) -> DataFrame:
    """What differs from the pinned source in a struct column."""
    of = lambda name: F.col(f"{source}.{name}")
    return integrity.violations(rows, subject, {f"source {k}": of(k) == v for k, v in PINNED.items()} | {"source retrieval_timestamp": integrity.zoned_timestamp(of("retrieval_timestamp"))})


def backup_rules(files: DataFrame, passages: DataFrame, source: dict[str, str]) -> DataFrame:
    """What keeps articles out of a backup of the given source."""
    d = lambda name: F.col(f"doc.{name}")
    own = integrity.violations(files, F.col("file"), {
        "no object of JSON": ~F.col("broken"), "file name is not the id": F.col("file") == F.concat(d("article_artifact_id"), F.lit(".json")), "other database": d("wiki_database") == source["wiki_database"],
        "other dump run": d("dump_run") == source["dump_run"], "page id": positive(d("page_id")), "namespace": d("namespace") == 0, "title": filled(d("canonical_title")),
        "revision id": positive(d("revision_id")), "parent revision id": d("parent_revision_id").isNull() | positive(d("parent_revision_id")), "revision timestamp": integrity.zoned_timestamp(d("revision_timestamp")),
        "wiki text": filled(d("raw_wikitext")), "extractor": filled(d("extractor_identity")), "configuration": d("extractor_configuration").isNotNull(),
        "history url": d("history_url").rlike("^https?://"), "revision url": d("permanent_revision_url").rlike("^https?://") & d("permanent_revision_url").contains(F.concat(F.lit("oldid="), d("revision_id"))),
        "other source": F.forall(F.array(*[d(f"source_snapshot.{k}").eqNullSafe(F.lit(v)) for k, v in source.items()]), lambda x: x),
        "redirect chain": d("redirect_chain").isNotNull() & F.forall(d("redirect_chain"), lambda r: filled(r["source_title"]) & filled(r["target_title"])),
        "passages are no list": d("extracted_passages").isNotNull(),
        "exclusions": d("structural_exclusions").isNotNull() & F.forall(d("structural_exclusions"), lambda e: F.coalesce(F.forall(e["heading_path"], filled), F.lit(False)) & positive(e["paragraph_ordinal"]) & filled(e["structure_type"]) & filled(e["reason"])),
    })
    each = integrity.violations(passages, F.coalesce("passage_id", "file"), {
        "passage id": filled(F.col("passage_id")), "passage of another article": F.col("article_artifact_id") == F.col("owner_id"),
        "passage heading path": (F.size("heading_path") > 0) & F.forall("heading_path", filled), "passage ordinal": positive(F.col("paragraph_ordinal")),
        "passage text": filled(F.col("normalized_text")), "passage structure": F.col("structure") == STRUCTURE,
    })
    places = integrity.repeated(passages.select("owner_id", F.to_json("heading_path").alias("path"), "paragraph_ordinal"), "owner_id", "path", "paragraph_ordinal").select(F.lit("passage place twice").alias("check_id"), F.col("owner_id").alias("subject"))
    return own.unionByName(each).unionByName(places)


def result_faults(result: object, source: dict[str, str]) -> list[str]:
    """What keeps an acquisition result out of a backup, first things first."""
    if not isinstance(result, dict):
        return ["result is no object"]
    whole = lambda name, value: type(result.get(name)) is int and result[name] == value
    out = [] if whole("schema_version", 1) else ["result has another version"]
    out += [] if result.get("scan_passes") == 2 else ["result is not of two passes"]
    out += [] if result.get("failures") == [] else ["result has failures"]
    out += [] if result.get("source_snapshot") == source else ["result is of another source"]
    wins = result.get("successes")
    if not isinstance(wins, list) or not wins:
        return [*out, "result has no success"]
    if not all(isinstance(w, dict) and all(isinstance(w.get(k), str) and w[k] for k in ("candidate_title", "article_artifact_id")) for w in wins):
        return [*out, "result has a bad success"]
    ids = [w["article_artifact_id"] for w in wins]
    return out + ["result has a success twice"] * (len(ids) != len(set(ids)))


def discovery_faults(document: object) -> list[str]:
    if not isinstance(document, dict) or type(document.get("schema_version")) is not int or document["schema_version"] != 1:
        return ["discovery has another version"]
    records = document.get("records")
    return [] if isinstance(records, list) and records and all(isinstance(r, dict) for r in records) else ["discovery has no records"]


def release_rules(passages: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """What keeps a corpus and its decisions from being released.

    passages: passage_id, article_artifact_id. events: a decision log. files: file, doc of the articles.
    """
    ids = passages.select("passage_id")
    named = events.select("passage_id").distinct().join(ids, "passage_id", "left_anti").select(F.lit("unknown passage").alias("check_id"), F.col("passage_id").cast("string").alias("subject"))
    decided = curation.effective(events)
    open_ = ids.join(decided.select("passage_id", F.col("action").alias("last")), "passage_id", "left")
    open_ = open_.where("last is null or last = 'defer'").select(F.when(F.col("last").isNull(), "undecided passage").otherwise("deferred passage").alias("check_id"), F.col("passage_id").cast("string").alias("subject"))
    fields = integrity.violations(files, F.col("file"), {
        "article_artifact_id": filled(F.col("doc.article_artifact_id")), "canonical_title": filled(F.col("doc.canonical_title")), "page_id": F.col("doc.page_id").isNotNull(), "revision_id": F.col("doc.revision_id").isNotNull(),
        "revision_timestamp": filled(F.col("doc.revision_timestamp")), "source_snapshot": F.col("doc.source_snapshot").isNotNull(),
    })
    sources = files.agg(F.count_distinct(F.to_json("doc.source_snapshot", {"ignoreNullFields": "false"})).alias("n")).where("n > 1").select(F.lit("several sources").alias("check_id"), F.col("n").cast("string").alias("subject"))
    return named.unionByName(open_).unionByName(fields).unionByName(sources)


def inventory_rules(listed: DataFrame, found: DataFrame) -> DataFrame:
    """What is wrong with a release's inventory (artifact_filename, article_artifact_id, artifact_sha256) and the files (file, sha256) it names."""
    form = integrity.violations(listed, F.coalesce("artifact_filename", F.lit("")), {
        "file name": filled(F.col("artifact_filename")) & ~F.col("artifact_filename").rlike("/|^[.]{1,2}\\z"), "article id": filled(F.col("article_artifact_id")), "digest": F.length("artifact_sha256") == 64,
    })
    out = form
    for column in ("artifact_filename", "article_artifact_id"):
        out = out.unionByName(integrity.repeated(listed.select(F.col(column).alias("subject")).where("subject is not null"), "subject").select(F.lit(f"{column} twice").alias("check_id"), "subject"))
    both = listed.join(found.select(F.col("file").alias("on_disk"), "sha256"), F.col("artifact_filename") == F.col("on_disk"), "left")
    state = F.when(F.col("on_disk").isNull(), "missing file").when(F.col("sha256") != F.col("artifact_sha256"), "changed file")
    return out.unionByName(both.select(state.alias("check_id"), F.col("artifact_filename").alias("subject")).where("check_id is not null"))


def raise_first(found: DataFrame, what: str) -> None:
    """ValueError for the least (check_id, subject), if there is one."""
    row = found.orderBy("check_id", "subject").first()
    if row:
        raise ValueError(f"{what}: {row['check_id']}: {row['subject']}")


def parsed(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError as error:
        raise ValueError(f"no JSON: {error}") from error
