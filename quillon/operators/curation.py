"""Decisions on passages: an append-only log of classify, defer and undo events, and views of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions import text as T
from . import integrity

# Keys and the labels they give.
CLASSIFICATIONS = {"l": "internal lore", "w": "external creation history", "a": "analysis or reception", "d": "adaptation material", "r": "reference or administrative material"}


def action_of(key: Column) -> Column:
    """(action, classification) that a key stands for, or nulls: labels classify, s defers."""
    label = F.create_map(*[F.lit(x) for pair in CLASSIFICATIONS.items() for x in pair])[key]
    return F.struct(F.when(label.isNotNull(), "classify").when(key == "s", "defer").alias("action"), label.alias("classification"))


def active(events: DataFrame) -> DataFrame:
    """Classify and defer events that no undo event supersedes."""
    undone = events.where("action = 'undo' and supersedes_event_id is not null").select(F.col("supersedes_event_id").alias("undone_id"))
    return events.where("action <> 'undo'").join(undone, F.col("id") == F.col("undone_id"), "left_anti")


def effective(events: DataFrame) -> DataFrame:
    """The last active event of each passage."""
    rest = [c for c in events.columns if c != "passage_id"]
    return active(events).groupBy("passage_id").agg(F.max_by(F.struct(*rest), F.col("id")).alias("x")).select("passage_id", "x.*")


def latest_active(events: DataFrame) -> DataFrame:
    return active(events).orderBy(F.desc("id")).limit(1)


def depths(events: DataFrame, scope: str, width: int = 1 << 16) -> DataFrame:
    """events (scope, id, undo) with depth and idle: how many are active after each one, and whether an undo found none.

    An undo with nothing to take back doesn't lower the depth, as the running least of the plain sum shows. A long scope
    is cut at every `width` ids: each part is a task's, and what is ahead of it comes from a table with a row for each part.
    """
    rows = events.withColumns({"part_": F.floor(F.col("id") / width), "one_": F.when(F.col("undo"), -1).otherwise(1)})
    inside = Window.partitionBy(scope, "part_").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum_", F.sum("one_").over(inside))
    rows = rows.withColumns({"low_": F.min("sum_").over(inside), "before_": F.min("sum_").over(Window.partitionBy(scope, "part_").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))})
    parts = rows.groupBy(F.col(scope).alias("scope_"), F.col("part_").alias("of_")).agg(F.sum("one_").alias("total"), F.min("sum_").alias("low"))
    ahead = Window.partitionBy("scope_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base_", F.coalesce(F.sum("total").over(ahead), F.lit(0)))
    parts = parts.select("scope_", "of_", "base_", F.least(F.lit(0), F.min(F.col("base_") + F.col("low")).over(ahead)).alias("floor_"))
    rows = rows.join(parts, rows[scope].eqNullSafe(F.col("scope_")) & (F.col("part_") == F.col("of_")))
    least = lambda own: F.least(F.col("floor_"), F.col("base_") + F.col(own))
    depth = F.col("base_") + F.col("sum_") - least("low_")
    idle = F.col("undo") & (least("low_") < least("before_"))
    return rows.withColumns({"depth": depth, "idle": idle}).drop("part_", "one_", "sum_", "low_", "before_", "scope_", "of_", "base_", "floor_")


def undo_pairs(events: DataFrame, scope: str) -> DataFrame:
    """Which event each undo of a scope takes back: the latest that is not taken back yet.

    events: scope, id, undo. Depth counts what is active; an undo meets the last event that reached the
    depth it leaves. An undo with nothing to take back does nothing.
    """
    rows = depths(events, scope)
    rows = rows.withColumn("level_", F.struct(F.col(scope).alias("scope"), F.when(F.col("undo"), F.col("depth") + 1).otherwise(F.col("depth")).alias("depth")))
    rows = rows.withColumn("own_", F.when(~F.col("undo"), F.col("id")))
    rows = integrity.with_last(rows, "level_", ["id"], F.floor(F.col("id") / (1 << 16)), "own_", "taken_")
    return rows.withColumn("undone_id", F.when(F.col("undo") & ~F.col("idle"), F.col("taken_"))).select(scope, "id", "undo", "undone_id")


def counts(decisions: DataFrame, total: Column | int, labels: list[str]) -> DataFrame:
    """(label, n) for every label, deferred, undecided and total; zero where there is none."""
    spark = decisions.sparkSession
    got = decisions.groupBy("label").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(i, x) for i, x in enumerate([*labels, "deferred"])], "ord int, label string")
    rows = names.join(got, "label", "left").select("ord", "label", F.coalesce("n", F.lit(0)).alias("n"))
    decided = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rest = decided.select(F.lit(len(labels) + 1).alias("ord"), F.lit("undecided").alias("label"), (F.lit(total) - F.col("n")).alias("n"))
    whole = spark.createDataFrame([(len(labels) + 2, "total", int(total))], "ord int, label string, n long")
    return rows.unionByName(rest).unionByName(whole)


def undecided(passages: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    return passages.join(decisions.select(key).distinct(), key, "left_anti")


def context(passages: DataFrame, group: str, order: str, text: str, before: int, after: int) -> DataFrame:
    """Up to `before` passages ahead of each one and `after` behind it, inside its group."""
    w = Window.partitionBy(group).orderBy(order)
    return passages.withColumns({"previous": F.collect_list(text).over(w.rowsBetween(-before, -1)), "following": F.collect_list(text).over(w.rowsBetween(1, after))})


def _kept(frame: DataFrame) -> DataFrame:
    return scratch.table(frame, "kept")


def progress(passages: DataFrame, group: str, order: str) -> DataFrame:
    """Numbers of group, passage in its group, and passage in all, each with its total.

    Groups are dealt by range and numbered inside each range; only the ranges' totals meet in one task.
    """
    sizes = passages.groupBy(group).agg(F.count("*").alias("passages"))
    ranges = _kept(sizes.repartitionByRange(group).withColumn("range", F.spark_partition_id()))
    total = ranges.groupBy("range").agg(F.count("*").alias("n"), F.sum("passages").alias("p"), F.min(group).alias("least"))
    ahead = Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    total = total.select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n_ahead"), F.coalesce(F.sum("p").over(ahead), F.lit(0)).alias("p_ahead"))
    inside = Window.partitionBy("range").orderBy(group)
    sizes = ranges.join(F.broadcast(total), "range").select(group, "passages", (F.col("n_ahead") + F.row_number().over(inside)).cast("int").alias("group_no"), (F.col("p_ahead") + F.sum("passages").over(inside) - F.col("passages")).alias("earlier"))
    totals = ranges.agg(F.count("*").alias("groups"), F.sum("passages").alias("all_passages"))
    rows = passages.withColumn("passage_no", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    rows = rows.join(sizes, group).withColumn("overall_no", F.col("earlier") + F.col("passage_no"))
    return rows.crossJoin(F.broadcast(totals)).drop("earlier")  # one row


def open_passages(passages: DataFrame, decisions: DataFrame, key: str, mode: str = "undecided", excluded: DataFrame | None = None) -> DataFrame:
    """Passages that a mode still has to visit: the undecided ones, or those whose decision is to defer; none of the excluded."""
    rows = undecided(passages, decisions, key) if mode == "undecided" else passages.join(decisions.where("action = 'defer'").select(key), key, "left_semi")
    return rows if excluded is None else rows.join(excluded.select(key).distinct(), key, "left_anti")


def next_after(passages: DataFrame, open_: DataFrame, cursors: DataFrame, position: str, buckets: int = 1024) -> DataFrame:
    """For each cursor the first open position after it, wrapping around; the cursor itself comes last.

    A cursor that is no passage starts at the first one. Positions are dealt by range to buckets: the next
    one is in the cursor's bucket, else it is the least of the next bucket that has any.
    """
    bounds = F.broadcast(open_.agg(F.min(position).alias("first_open"), F.max(position).alias("last_open")))  # one row
    width = F.greatest(F.lit(1), F.ceil((F.col("last_open") - F.col("first_open") + 1) / buckets))
    bucket = F.least(F.lit(buckets), F.greatest(F.lit(-1), F.floor((F.col("p") - F.col("first_open")) / width))).cast("int")
    known = cursors.select(F.col(position).alias("cursor")).join(passages.select(F.col(position).alias("p")).distinct(), F.col("cursor") == F.col("p"), "left")
    rows = known.select("cursor", F.lit(1).alias("is_cursor"), "p").unionByName(open_.select(F.lit(None).cast("long").alias("cursor"), F.lit(0).alias("is_cursor"), F.col(position).alias("p")))
    rows = rows.crossJoin(bounds).withColumn("bucket", bucket)
    own = F.min(F.when(F.col("is_cursor") == 0, F.col("p"))).over(Window.partitionBy("bucket").orderBy("p").rangeBetween(1, Window.unboundedFollowing))
    least = rows.where("is_cursor = 0").groupBy("bucket").agg(F.min("p").alias("least"))
    every = passages.sparkSession.range(-1, buckets + 1).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(least), "bucket", "left")
    later = every.select("bucket", F.min("least").over(Window.orderBy("bucket").rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    rows = rows.withColumn("own", own).where("is_cursor = 1").join(F.broadcast(later), "bucket", "left")
    return rows.select("cursor", F.coalesce("own", "later", "first_open").alias("next_open"))


def prior_links(events: DataFrame) -> DataFrame:
    """(id, prior_id): the active event of the same passage that a classify or defer event takes the place of.

    events: id, action, passage_id, supersedes_event_id of undo events. An event counts as long as no undo
    before this one took it back.
    """
    undone = events.where("action = 'undo' and supersedes_event_id is not null").groupBy(F.col("supersedes_event_id").alias("gone_id")).agg(F.min("id").alias("gone_at"))
    lived = events.where("action <> 'undo'").join(undone, F.col("id") == F.col("gone_id"), "left")
    lived = lived.select(F.col("passage_id").cast("string").alias("key"), F.col("id").cast("long").alias("id"), F.coalesce("gone_at", F.lit((1 << 63) - 1)).alias("until"))
    return latest_alive(lived).withColumnRenamed("prior", "prior_id")


class _Alive:
    """Events that may yet be the latest one alive: starts rise, ends fall. One that a later event outlives is never asked for."""

    def __init__(self):
        self.start: list[int] = []
        self.until: list[int] = []

    def latest(self, at: int) -> int | None:
        while self.until and self.until[-1] <= at:
            self.start.pop()
            self.until.pop()
        return self.start[-1] if self.start else None

    def add(self, start: int, until: int) -> None:
        while self.until and self.until[-1] <= until:
            self.start.pop()
            self.until.pop()
        self.start.append(start)
        self.until.append(until)


def latest_alive(events: DataFrame) -> DataFrame:
    """(id, prior) of events (key, id, until): the latest earlier event of the key that is alive at id, that is, whose until is greater.

    Each event is put on a stack and taken off it at most once. Events are dealt by ranges of (key, id), so a key with
    very many of them is the work of many tasks. A range answers for all keys that begin in it; of a key that goes on from
    the range before, only the events that nothing in the range answers, and what stood on the stacks at the ends of its
    ranges, meet in a second pass.
    """
    kinds = "key string, id long, kind int, value long"
    names, types = ["key", "id", "kind", "value"], [pa.string(), pa.int64(), pa.int32(), pa.int64()]
    answer, question, standing = 0, 1, 2

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, seen, alive = None, True, False, _Alive()
        for batch in batches:
            rows = []
            for own, at, until in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen or own != key:
                    key, head, seen, alive = own, not seen, True, _Alive()
                prior = alive.latest(at)
                rows.append((own, at, question if prior is None and head else answer, prior))
                alive.add(at, until)
            if rows:
                yield batch_of(rows)
        if alive.start:
            yield batch_of([(key, at, standing, until) for at, until in zip(alive.start, alive.until, strict=True)])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, alive = None, False, _Alive()
        for batch in batches:
            rows = []
            for own, at, kind, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen or own != key:
                    key, seen, alive = own, True, _Alive()
                if kind == question:
                    rows.append((own, at, answer, alive.latest(at)))
                else:
                    alive.add(at, value)
            if rows:
                yield batch_of(rows)

    found = events.select("key", "id", "until").repartitionByRange("key", "id").sortWithinPartitions("key", "id").mapInArrow(ranges, kinds)
    found = scratch.table(found, "alive")
    left = found.where(F.col("kind") != answer).repartition("key").sortWithinPartitions("key", "id", F.desc("kind")).mapInArrow(rest, kinds)
    return found.where(F.col("kind") == answer).unionByName(left).select("id", F.col("value").alias("prior"))


def resume(stored: Column, known: Column, following: Column) -> Column:
    """The stored cursor if it is a passage, decided or not; else the next one."""
    return F.when(known, stored).otherwise(following)


def evidence(**fields: Column) -> Column:
    """Compact JSON of the fields in sorted order, nulls included."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def evidence_frames(passages: DataFrame, rubric: str, wide: bool, width: int = 80) -> DataFrame:
    """passages with evidence: the canonical JSON of what a curator sees of a passage.

    passages: article_id, article_title, source_pos, passage_id, heading_path, paragraph_ordinal, text. Compact
    frames show one passage on either side, shortened to the width; wide ones show two, whole.
    """
    reach = 2 if wide else 1
    w = Window.partitionBy("article_id").orderBy("source_pos")
    near = F.struct(F.col("passage_id").alias("id"), T.snippet(F.col("text"), max(1, width - 1), wide).alias("text"))
    rows = passages.withColumns({"preceding_": F.collect_list(near).over(w.rowsBetween(-reach, -1)), "following_": F.collect_list(near).over(w.rowsBetween(1, reach))})
    json = evidence(
        article=F.struct(F.col("article_id").alias("id"), F.col("article_title").alias("title")), context_mode=F.lit("expanded" if wide else "compact"), following=F.col("following_"), preceding=F.col("preceding_"),
        rubric_id=F.lit(rubric), target=F.struct("heading_path", F.col("passage_id").alias("id"), "paragraph_ordinal", "text"),
    )
    return rows.withColumn("evidence", json).drop("preceding_", "following_")
