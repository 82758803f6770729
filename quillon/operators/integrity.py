"""Constraints as violation rows, inventories and their comparison."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Forms of release ids, backup labels, members and digests.
RELEASE_ID = "^[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\\z"
BACKUP_LABEL = "^[a-z0-9][a-z0-9._-]{0,63}\\z"
REQUIRED_PATHS = ("data/corpus/source/source-snapshot.json", "data/corpus/acquisition-result.json")
REQUIRED_FOLDERS = ("data/discovery/", "data/corpus/articles/")
MEMBER = "^(data/corpus/source/source-snapshot[.]json|data/corpus/acquisition-result[.]json|data/(discovery|corpus/articles)/[^/]+[.]json)\\z"
HEX_40, HEX_64 = "^[0-9a-f]{40}\\z", "^[0-9a-f]{64}\\z"
CONTACT = "@|^\\s*https?://"


def violations(rows: DataFrame, subject: Column, checks: dict[str, Column]) -> DataFrame:
    """(check_id, subject) for every check that is not true of a row."""
    failed = {name: ~F.coalesce(ok, F.lit(False)) for name, ok in checks.items()}
    names = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in failed.items()]), lambda x: x.isNotNull())
    return rows.where(reduce(or_, failed.values())).select(F.explode(names).alias("check_id"), subject.alias("subject"))  # names are listed for the few that fail


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def constant(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    """How many different combinations of the columns each group has."""
    return rows.groupBy(group).agg(F.count_distinct(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).alias("variants"))


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(F.lit("left only").alias("side"), key).unionByName(b.join(a, key, "left_anti").select(F.lit("right only").alias("side"), key))


def inventory(rows: DataFrame, path: Column, content: Column) -> DataFrame:
    """(path, size_bytes, sha256)"""
    raw = F.encode(content, "UTF-8")
    return rows.select(path.alias("path"), F.length(raw).cast("long").alias("size_bytes"), F.sha2(raw, 256).alias("sha256"))


def compared(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(path, state) of members that are missing, unexpected or changed."""
    m, f = manifest.select("path", F.struct("size_bytes", "sha256").alias("m")), found.select("path", F.struct("size_bytes", "sha256").alias("f"))
    state = F.when(F.col("f").isNull(), "missing").when(F.col("m").isNull(), "unexpected").when(F.col("m") != F.col("f"), "changed")
    return m.join(f, "path", "full").select("path", state.alias("state")).where("state is not null")


def with_previous(rows: DataFrame, group: str, order: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """rows with the value of the row before in the group; order is a number.

    A long group is cut at every `width` numbers, so no task has all of it; what ends a part is carried to the next one.
    """
    rows = rows.where(F.col(order).isNotNull()).withColumn("part_", F.floor(F.col(order) / width))
    ends = rows.groupBy(group, "part_").agg(F.max_by(value, order).alias("end"))
    carried = ends.select(group, "part_", F.lag("end").over(Window.partitionBy(group).orderBy("part_")).alias(value), F.lit(False).alias("row_"))
    rows = rows.withColumn("row_", F.lit(True)).unionByName(carried, allowMissingColumns=True)  # stands ahead of its part
    return rows.withColumn(out, F.lag(value).over(Window.partitionBy(group, "part_").orderBy("row_", order))).where("row_").drop("part_", "row_")


def numbered(rows: DataFrame, group: str, order: str, part: Column, out: str) -> DataFrame:
    """rows with their number in the group's order, from 0; part never falls along the order, and each part is a task's work."""
    rows = rows.withColumn("part_", part)
    sizes = rows.groupBy(F.col(group).alias("group_"), F.col("part_").alias("of_")).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("group_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("group_", "of_", F.coalesce(ahead, F.lit(0)).alias("ahead_"))
    rows = rows.withColumn("own_", F.row_number().over(Window.partitionBy(group, "part_").orderBy(order)) - 1)
    rows = rows.join(sizes, rows[group].eqNullSafe(F.col("group_")) & rows["part_"].eqNullSafe(F.col("of_")))
    return rows.withColumn(out, F.col("ahead_") + F.col("own_")).drop("part_", "own_", "ahead_", "group_", "of_")


def with_last(rows: DataFrame, group: str, order: list[str], part: Column, value: str, out: str) -> DataFrame:
    """rows with the last value up to each row, itself included, that is not null, in the group's order.

    part is a number that never falls along the order. Each part of a group is a task's work; what its last row
    has is carried to the parts after it, which meet with a row each.
    """
    rows = rows.withColumn("part_", part)
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = rows.groupBy(F.col(group).alias("group_"), F.col("part_").alias("of_")).agg(F.max_by(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"))), known).alias("end"))
    ahead = Window.partitionBy("group_").orderBy("of_").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("group_", "of_", F.last("end", ignorenulls=True).over(ahead)["v"].alias("carried_"))
    inside = Window.partitionBy(group, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own_", F.last(value, ignorenulls=True).over(inside))
    rows = rows.join(ends, rows[group].eqNullSafe(F.col("group_")) & rows["part_"].eqNullSafe(F.col("of_")))
    return rows.withColumn(out, F.coalesce("own_", "carried_")).drop("part_", "own_", "group_", "of_", "carried_")


def out_of_order(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value does not exceed the one before it in the group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("before", before).where(F.col(value) <= F.col("before"))


def dangling(events: DataFrame, *scope: str) -> DataFrame:
    """Events (id, action, passage_id, supersedes_event_id) whose superseded event is no earlier classify or defer event of the passage.

    scope: columns that both events share, such as the log: ids count within it.
    """
    old = events.where("action <> 'undo'").select(F.col("id").alias("old_id"), F.col("passage_id").alias("old_passage"), *[F.col(c).alias(f"old_{c}") for c in scope])
    same = (F.col("supersedes_event_id") == F.col("old_id")) & (F.col("old_id") < F.col("id")) & (F.col("old_passage") == F.col("passage_id"))
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return events.where("supersedes_event_id is not null").join(old, same, "left_anti")


def out_of_phase(rows: DataFrame, group: str, order: str, rank: Column, once: tuple[int, ...]) -> DataFrame:
    """Rows of a phase (rank) that a later one was seen before in the group, or of a phase that comes once and was there."""
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("phase", rank)
    latest = F.max("phase").over(before)
    return rows.withColumn("latest", latest).where((F.col("phase") < F.col("latest")) | ((F.col("phase") == F.col("latest")) & F.col("phase").isin(*once)))


def sidecar(line: Column) -> Column:
    """(digest, name) of a sidecar's line, or null for any other form."""
    form = "^([0-9a-f]{64})  (\\S+)\n?\\z"
    return F.when(line.rlike(form), F.struct(F.regexp_extract(line, form, 1).alias("digest"), F.regexp_extract(line, form, 2).alias("name")))


def zoned_timestamp(value: Column) -> Column:
    """ISO 8601 with a T and a zone, in its long or its short form, and a real moment of a real zone."""
    day = F.regexp_replace(F.regexp_extract(value, "^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})T", 1), "-", "")
    hour, sixty = "([01][0-9]|2[0-3])", "[0-5][0-9]"
    time = f"{hour}(:{sixty}(:{sixty}([.,][0-9]+)?)?|{sixty}({sixty}([.,][0-9]+)?)?)?"
    zone = f"(Z|[+-]{hour}(:{sixty}(:{sixty}([.][0-9]+)?)?|{sixty}({sixty}([.][0-9]+)?)?)?)"
    return value.rlike(f"^[0-9]{{4}}-?[0-9]{{2}}-?[0-9]{{2}}T{time}{zone}\\z") & (day > "00010000") & F.try_to_timestamp(day, F.lit("yyyyMMdd")).isNotNull()


def backup_label(value: Column) -> Column:
    return value.rlike(BACKUP_LABEL) & ~value.contains("..") & ~value.rlike("(\\.tar|\\.tar\\.gz|\\.tgz)\\z")


def release_id(value: Column) -> Column:
    return value.rlike(RELEASE_ID)


def is_release_id(value: object) -> bool:
    return isinstance(value, str) and re.match(RELEASE_ID.replace("\\z", "\\Z"), value) is not None


def member_path(value: Column) -> Column:
    """A path that a backup may hold, in no other spelling."""
    return value.rlike(MEMBER) & (F.trim(value) == value) & ~F.exists(F.split(value, "/"), lambda x: x.isin("", ".", ".."))


def contact(value: Column) -> Column:
    return value.rlike(CONTACT)


def label_faults(label: object) -> list[str]:
    good = isinstance(label, str) and re.match(BACKUP_LABEL.replace("\\z", "\\Z"), label) and ".." not in label and not label.endswith((".tar", ".tar.gz", ".tgz"))
    return [] if good else [f"bad label {label!r}"]


def path_faults(path: str, also: str = "") -> list[str]:
    good = path == also or (re.match(MEMBER.replace("\\z", "\\Z"), path) and not {"", ".", ".."} & set(path.split("/")) and path == path.strip())
    return [] if good else [f"member {path!r} is not allowed"]


def first_violation(found: DataFrame, order: list[str]) -> None:
    """Raise for the check that comes first in order, if any check failed."""
    ranks = {name: i for i, name in enumerate(order)}
    rows = found.groupBy("check_id").agg(F.min("subject").alias("subject")).collect()  # one row for each check
    if rows:
        worst = min(rows, key=lambda r: ranks.get(r["check_id"], len(ranks)))
        raise ValueError(f"{worst['check_id']}: {worst['subject']}")
