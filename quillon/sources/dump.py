"""Page dumps: bzip2 or plain XML, read in splits at the ends of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .progress import Progress

PAGE = """title string, ns int, id long, redirect struct<_title string>,
revision struct<id long, parentid long, timestamp string, text struct<_VALUE string, _bytes long>>"""


class SourceError(ValueError):
    """The dump is not the expected one, or not whole."""


def records(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): the dump cut after every page; readers of a compressed file share it by blocks."""
    return spark.read.option("lineSep", "</page>").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def check(spark: SparkSession, path: str, database: str, progress: Progress | None = None) -> None:
    """Raise unless the dump names the database before its first page and is complete. progress is told of its records."""
    rows = records(spark, path)
    if progress is not None:
        with progress.watch(rows, pages=F.col("value").contains("<page>"), redirects=F.col("value").contains("<redirect ")) as watched:
            return _check(watched, database)
    return _check(rows, database)


def _check(rows: DataFrame, database: str) -> None:
    rows = rows.withColumn("pos", F.struct("path", "block", F.monotonically_increasing_id().alias("row")))  # tasks may read files in another order
    name = F.regexp_extract("value", "<siteinfo[\\s\\S]*?<dbname>\\s*([^<]*?)\\s*</dbname>", 1)
    before = F.regexp_extract("value", "^([\\s\\S]*?)(?:<page>|\\z)", 1).contains("</dbname>")
    found = rows.agg(
        F.count_if(F.col("value").contains("</mediawiki>")).alias("ends"),
        F.max(F.when(F.col("value").contains("<dbname>"), name)).alias("name"),
        F.max(F.when(F.col("value").contains("<dbname>"), before)).alias("early"),
        F.min(F.when(F.col("value").contains("<dbname>"), F.col("pos"))).alias("name_pos"),
        F.min(F.when(F.col("value").contains("<page>"), F.col("pos"))).alias("page_pos"),
        F.count_if(F.col("value").contains("<page>") & F.col("value").contains("</mediawiki>")).alias("open"),
    ).first()
    if not found["name"]:
        raise SourceError("dump names no database")
    if not found["early"] or (found["page_pos"] is not None and found["page_pos"] < found["name_pos"]):
        raise SourceError("dump names its database after a page")
    if found["name"] != database:
        raise SourceError(f"dump is of {found['name']}, not {database}")
    if found["ends"] != 1 or found["open"]:
        raise SourceError("dump is cut short")


def pages(spark: SparkSession, path: str, database: str | None = None) -> DataFrame:
    """Pages that have a revision, in the columns of the page table; with a database, only after check().

    scan_pos orders pages as they stand: by file, block of the file and row, whichever task reads which block.
    """
    if database is not None:
        check(spark, path, database)
    rows = records(spark, path).withColumn("scan_pos", F.struct("path", "block", F.monotonically_increasing_id().alias("row")))
    return parsed(rows)


def parsed(rows: DataFrame, *more: str) -> DataFrame:
    """The pages of records (scan_pos, value) that have a revision; more: other columns that stay."""
    rows = rows.where(F.col("value").contains("<page>"))
    body = F.concat(F.regexp_replace(F.regexp_extract("value", "(<page>[\\s\\S]*)", 1), "xml:space=\"preserve\"", ""), F.lit("</page>"))
    page = F.from_xml(body, PAGE, {"rowTag": "page", "ignoreSurroundingSpaces": "false", "mode": "FAILFAST"})
    rows = rows.select("scan_pos", *more, page.alias("p")).where("p.revision is not null")
    return rows.select(
        "scan_pos", *more, F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.ns", F.lit(-1)).alias("namespace"), F.coalesce("p.id", F.lit(0)).alias("page_id"),
        F.col("p.redirect._title").alias("redirect_target"), F.coalesce("p.revision.id", F.lit(0)).alias("revision_id"), F.col("p.revision.parentid").alias("parent_revision_id"),
        F.coalesce("p.revision.timestamp", F.lit("")).alias("revision_timestamp"), F.coalesce("p.revision.text._VALUE", F.lit("")).alias("raw_wikitext"),
    )
