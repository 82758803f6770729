"""Secret scans over an incremental ledger of contents, in DataFrame functions only.

Every version of a path is named by the SHA-256 of its text. The ledger holds a row for each pair of
content and rule version that was scanned. A run scans the pairs it has not seen, each content once
however many paths and versions have it, appends to the ledger, and joins findings back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store


@dataclass(frozen=True)
class Rule:
    """pattern: its matches, leftmost first, none overlapping; those stay whose group has the length asked for."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


# In order. Runs of the last two are as long as they can be, so asking for the length inside the pattern
# finds the same matches without cutting the text at every letter a to f.
RULES = (
    Rule("assign", 1, "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16),
)
_SPANS = "array<struct<start:int,kind:int,stop:int>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """(start, kind, stop) of the rule's matches, in code points: from the lengths of what lies between them."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    each = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), hits.alias("hit"), groups.alias("group"))
    empty = F.from_json(F.lit("[]"), _SPANS)

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        new = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(F.length(x["group"]) >= rule.least, F.concat(state["out"], new)).otherwise(state["out"]).alias("out"))

    # In pieces of the root of their number: one list that grew by every match would be copied for each.
    step = F.ceil(F.sqrt(F.size(each))).cast("int")

    def piece(state: Column, first: Column) -> Column:
        part = F.aggregate(F.slice(each, first, step), F.struct(state["at"].alias("at"), empty.alias("out")), add)
        return F.transform(F.array(part), lambda x: F.struct(x["at"].alias("at"), F.concat(state["lists"], F.array(x["out"])).alias("lists")))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("lists"))
    found = F.aggregate(F.sequence(F.lit(1), F.size(each), step), start, piece, lambda s: F.flatten(s["lists"]))
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), found).otherwise(empty)


def scan(versions: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, blob, found) of every version (path, text): found are the spans of all rules, in order.

    ledger: folder of the ledger, made and kept up where given; without it the ledger lives for this run.
    A null text counts as empty. A null path is a path of its own. Repeated rows come back repeated.
    """
    spark = versions.sparkSession
    rows = versions.select("path", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("blob", F.sha2(F.encode("text", "UTF-8"), 256))
    known = None
    if ledger is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(ledger)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            known = spark.read.parquet(ledger)
    kinds = F.array(*[F.lit(r.name) for r in rules])
    paths = rows.select("path", "blob")
    pairs = paths.groupBy("blob").agg(F.min("path").alias("rep")).select("blob", "rep", F.explode(kinds).alias("rule"))
    if known is not None:
        pairs = pairs.join(known.select("blob", "rule"), ["blob", "rule"], "left_anti")
    due = pairs.groupBy("blob").agg(F.first("rep").alias("rep"), F.collect_set("rule").alias("rules"))
    # One text of each content travels: the one under its least path (or under no path).
    texts = rows.select("path", "text", F.col("blob").alias("own"))
    due = due.select("blob", "rules", F.coalesce("rep", F.lit(0)).alias("rep"), F.col("rep").isNull().alias("none"))
    texts = texts.join(due.hint("shuffle_hash"), (F.coalesce("path", F.lit(0)) == F.col("rep")) & (F.col("path").isNull() == F.col("none")) & (F.col("own") == F.col("blob")))
    found = [F.struct(F.lit(r.name).alias("rule"), spans(F.col("text"), r, i).alias("spans")) for i, r in enumerate(rules)]
    new = texts.select("blob", F.explode(F.array(*[F.when(F.array_contains("rules", r.name), f) for r, f in zip(rules, found, strict=True)])).alias("x")).where("x is not null")
    new = new.select("blob", "x.rule", "x.spans").dropDuplicates(["blob", "rule"])
    if ledger is None:
        known = store.table(new, "ledger")
    else:
        new.write.mode("append").parquet(ledger)
        known = spark.read.schema(new.schema).parquet(ledger)
    # Runs that overlap may both append a pair; it counts once.
    merged = known.where(F.col("rule").isin([r.name for r in rules])).dropDuplicates(["blob", "rule"]).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found"))
    return paths.join(merged, "blob")


def findings(documents: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, n_<kind> ..., base_sha256, spans) of every document."""
    got = scan(documents.select(F.col("doc_id").alias("path"), "text"), ledger, rules)
    names = F.array(*[F.lit(r.kind) for r in rules])
    text = F.array_join(F.transform("found", lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"], F.lit(":"), x["stop"])), ",")

    def of(order: int):
        return lambda x: x["kind"] == order  # one parameter: filter gives a second one the position

    counts = [F.size(F.filter("found", of(i))).cast("long").alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    return got.select(F.col("path").alias("doc_id"), *counts, F.sha2(F.encode(text, "UTF-8"), 256).alias("base_sha256"), text.alias("spans"))
