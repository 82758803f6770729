"""Article documents, discovery records and source snapshots as files of JSON."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_document

SOURCE = "struct<wiki_database:string,dump_run:string,filename:string,source_url:string,retrieval_timestamp:string,extraction_profile:string>"
PASSAGE = "struct<passage_id:string,article_artifact_id:string,heading_path:array<string>,paragraph_ordinal:bigint,normalized_text:string,structure:string>"
EXCLUSION = "struct<heading_path:array<string>,paragraph_ordinal:bigint,structure_type:string,reason:string>"
# The fields of an article document.
ARTICLE = (
    f"article_artifact_id string, wiki_database string, dump_run string, source_snapshot {SOURCE}, page_id bigint, namespace bigint, canonical_title string, "
    "redirect_chain array<struct<source_title:string,target_title:string>>, revision_id bigint, parent_revision_id bigint, revision_timestamp string, permanent_revision_url string, "
    "history_url string, raw_wikitext string, extractor_identity string, "
    "extractor_configuration struct<supported_structure:string,lead_heading:string,remove_inline_references:boolean,replace_links_with_display_labels:boolean,exclude_lists_tables_quotes_and_unresolved_templates:boolean,whitespace_normalization:string>, "
    f"extracted_passages array<{PASSAGE}>, structural_exclusions array<{EXCLUSION}>"
)
DISCOVERY = "schema_version bigint, records array<struct<discovery_route:string,discovery_reference:string,observed_page_title:string,observed_page_id:bigint,discovery_timestamp:string>>"


def json_files(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(file, size_bytes, sha256, body, broken, doc) of every *.json of a folder.

    A field that is missing, null or of another type is null in doc; broken tells of text that is no JSON
    object or has a field of another type.
    """
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("body"))
    rows = rows.withColumn("doc", F.from_json("body", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}))
    return rows.withColumn("broken", F.col("doc._broken").isNotNull() | F.col("doc").isNull() | ~F.trim("body").startswith("{"))


def passages(files: DataFrame) -> DataFrame:
    """(file, article_artifact_id, canonical_title, source_pos, passage columns) of article files; source_pos is the order in the article."""
    rows = files.select("file", F.col("doc.article_artifact_id").alias("owner_id"), F.col("doc.canonical_title").alias("canonical_title"), F.posexplode("doc.extracted_passages").alias("source_pos", "p"))
    return rows.select("file", "owner_id", "canonical_title", "source_pos", "p.*")


def discoveries(spark: SparkSession, path: str) -> DataFrame:
    """(ord, discovery_route ...) of a discovery file; ValueError for another version or without records."""
    rows = spark.read.schema(DISCOVERY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    one = rows.select("schema_version", F.col("records").isNotNull().alias("has")).first()
    if one is None or one["schema_version"] != 1 or not one["has"]:
        raise ValueError("unsupported discovery record schema")
    return rows.select(F.posexplode("records").alias("ord", "r")).select("ord", "r.*")


def write_new(path: Path, value: object) -> Path:
    """A canonical document under a name that is not taken; FileExistsError if it is."""
    if path.exists():
        raise FileExistsError(f"{path} is a retained record")
    path.parent.mkdir(parents=True, exist_ok=True)
    stage = path.with_name(f".{path.name}.{os.getpid()}")
    stage.write_text(canonical_document(value), encoding="utf-8")
    os.replace(stage, path)
    return path


def write_result(folder: Path, name: str, value: object, stamp: Callable[[], str]) -> Path:
    """The document as name.json, or with a time stamp in its name where one is there."""
    path = folder / f"{name}.json"
    return write_new(folder / f"{name}-{stamp()}.json" if path.exists() else path, value)


def source_snapshot(path: Path, fresh: dict[str, str]) -> tuple[dict[str, str], bool]:
    """The snapshot that path holds, or a fresh one; and whether it is new. A field too many or too few is an error."""
    if not path.exists():
        return fresh, True
    held = json.loads(path.read_text(encoding="utf-8"))
    if not isinstance(held, dict) or set(held) != set(fresh):
        raise ValueError(f"{path} is no source snapshot")
    return held, False
