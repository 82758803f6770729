"""Decisions on articles, sections and passages: passages inherit, and the most specific decision counts.

A scope is an article and a path in it: the empty path is the article, a prefix of a heading path is a section with all
below it, and a passage is its own id. Decisions are a log; one ends when a later one names it as superseded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch


def scope_key(path: Column) -> Column:
    """A section's path as one text. Headings hold no line ends, so different paths have different texts."""
    return F.array_join(path, "\n")


def standing(decisions: DataFrame, rubric: str) -> DataFrame:
    """(article_id, path, passage_id, label, state, decision_id): what holds for each scope with an active decision.

    decisions: id, article_id, path, passage_id, action, classification, rubric_id, supersedes_event_id. An event that names another as
    superseded ends it; an undo does no more than that. state is classified, deferred, stale (decided under another
    rubric) or ambiguous (active decisions that differ); time never decides between two.
    """
    ended = decisions.where("supersedes_event_id is not null").select(F.col("supersedes_event_id").alias("id")).distinct()
    rows = decisions.where("action <> 'undo'").join(ended, "id", "left_anti")
    label = F.when(F.col("action") == "classify", F.col("classification")).otherwise("deferred")
    rows = rows.groupBy("article_id", scope_key(F.col("path")).alias("path"), "passage_id").agg(
        F.max("id").alias("decision_id"), F.min(label).alias("label"), (F.min(label) != F.max(label)).alias("differ"), F.bool_or(F.col("rubric_id") != rubric).alias("old"),
    )
    state = F.when(F.col("differ"), "ambiguous").when(F.col("old"), "stale").when(F.col("label") == "deferred", "deferred").otherwise("classified")
    return rows.select("article_id", "path", "passage_id", F.when(state == "classified", F.col("label")).alias("label"), state.alias("state"), "decision_id")


def inherited(passages: DataFrame, decisions: DataFrame, rubric: str) -> DataFrame:
    """passages (article_id, heading_path, passage_id, ...) with label, state, depth and decision_id of the scope that decides.

    depth counts the headings of that scope, -1 stands for the passage itself, null for none: state is undecided then. A
    stale or ambiguous decision still decides, for nothing: what an outer scope says does not show through. One
    join for each depth that has decisions, with one row for a scope, so passages are never multiplied.
    """
    held = scratch.table(standing(decisions, rubric), "standing")
    depth = F.when(F.col("passage_id").isNotNull(), -1).when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "\n")))
    held = held.withColumn("depth", depth)
    depths = sorted(r["depth"] for r in held.select("depth").distinct().collect())  # headings nest a few levels
    out, found = passages, []
    for d in depths:
        own = held.where(F.col("depth") == d).select(F.col("article_id").alias("a_"), F.col("passage_id" if d < 0 else "path").alias("p_"), F.struct("label", "state", "depth", "decision_id").alias(f"scope_{d}_"))
        key = F.col("passage_id") if d < 0 else F.when(F.size("heading_path") >= d, scope_key(F.slice("heading_path", 1, d)) if d else F.lit(""))
        out = out.withColumn("key_", key).join(own, (F.col("article_id") == F.col("a_")) & (F.col("key_") == F.col("p_")), "left").drop("key_", "a_", "p_")
        found.append(f"scope_{d}_")
    best = [found[0], *reversed(found[1:])] if depths[:1] == [-1] else found[::-1]
    first = F.coalesce(*best) if best else F.lit(None).cast("struct<label:string,state:string,depth:int,decision_id:long>")
    out = out.withColumn("scope_", first)
    return out.select(*passages.columns, F.col("scope_.label").alias("label"), F.coalesce("scope_.state", F.lit("undecided")).alias("state"), F.col("scope_.depth").alias("depth"), F.col("scope_.decision_id").alias("decision_id"))


def admitted(passages: DataFrame, label: str) -> DataFrame:
    """Of passages with label and state, those that a release may hold."""
    return passages.where((F.col("state") == "classified") & (F.col("label") == label))
