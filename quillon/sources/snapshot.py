"""Curation snapshots: canonical JSON lines of metadata, events and one session state."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import reduce
from operator import or_
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..functions.text import canonical_json, canonical_line
from ..operators import integrity

# Record fields of the format.
EVENT = ("id", "action", "passage_id", "classification", "rubric_id", "question", "evidence", "semantic_answer", "created_at", "supersedes_event_id")
SESSION = ("singleton", "current_passage_id", "current_undecided_passage_id", "current_deferred_passage_id")
METADATA = ("corpus_fingerprint", "rubric_id")
PHASES = ("curation_snapshot", "metadata", "audit_event", "session_state")
EVENTS_SCHEMA = "id long, action string, passage_id string, classification string, rubric_id string, question string, evidence string, semantic_answer string, created_at string, supersedes_event_id long"


class SnapshotError(ValueError):
    pass


def _need(good: bool, line: int, what: str) -> None:
    if not good:
        raise SnapshotError(f"line {line}: {what}")


def validated(lines: list[str], labels: tuple[str, ...]) -> tuple[dict[str, str], list[dict], dict]:
    """(metadata, events, session) of a snapshot's lines; raises for the first record that breaks a rule."""
    metadata: dict[str, str] = {}
    events: list[dict] = []
    sessions: list[dict] = []
    by_id: dict[int, dict] = {}
    phase = -1
    for n, line in enumerate(lines, 1):
        try:
            record = json.loads(line)
        except ValueError as error:
            raise SnapshotError(f"line {n}: no JSON") from error
        _need(isinstance(record, dict), n, "no object")
        kind = record.pop("record_type", None)
        _need(kind in PHASES, n, "unknown record type")
        at = PHASES.index(kind)
        _need(at >= phase and (at > phase or at in (1, 2)) and (n > 1 or at == 0), n, "record out of order")
        phase = at
        if at == 0:
            _need(record == {"schema_version": 1} and record["schema_version"] is not True, n, "unknown version")
        elif at == 1:
            _need(set(record) == {"key", "value"} and all(isinstance(v, str) and v for v in record.values()), n, "bad metadata")
            _need(record["key"] in METADATA and record["key"] not in metadata, n, "unknown or repeated metadata")
            metadata[record["key"]] = record["value"]
        elif at == 2:
            _event(record, n, metadata, events, by_id, labels)
        else:
            _need(set(record) == set(SESSION) and record["singleton"] == 1 and record["singleton"] is not True, n, "bad session state")
            _need(all(record[k] is None or (isinstance(record[k], str) and record[k]) for k in SESSION[1:]), n, "bad cursor")
            sessions.append(record)
    _need(set(metadata) == set(METADATA), len(lines), "metadata is missing")
    _need(len(sessions) == 1, len(lines), "session state is missing")
    return metadata, events, sessions[0]


def _event(record: dict, n: int, metadata: dict, events: list[dict], by_id: dict[int, dict], labels: tuple[str, ...]) -> None:
    _need(set(record) == set(EVENT), n, "bad event fields")
    number, prior = record["id"], record["supersedes_event_id"]
    _need(type(number) is int and number > (events[-1]["id"] if events else 0), n, "ids must be positive and rise")
    _need(record["action"] in ("classify", "defer", "undo"), n, "unknown action")
    for field in ("passage_id", "rubric_id", "question", "evidence", "semantic_answer", "created_at"):
        _need(isinstance(record[field], str) and record[field] != "", n, f"{field} must be a text")
    _need(record["rubric_id"] == metadata.get("rubric_id"), n, "other rubric")
    _need((record["classification"] in labels) if record["action"] == "classify" else record["classification"] is None, n, "bad classification")
    _need(prior is None or type(prior) is int, n, "bad superseded event")
    _need(record["action"] != "undo" or prior is not None, n, "undo of nothing")
    if prior is not None:
        old = by_id.get(prior)
        _need(old is not None and old["action"] != "undo" and old["passage_id"] == record["passage_id"], n, "superseded event is none of this passage")
    by_id[number] = record
    events.append(record)


# What the rules ask of a record: these fields as texts, as whole numbers, or only whether they hold a text; and the fields of each kind.
TEXTS = ("record_type", "key", "value", "action", "passage_id", "rubric_id", "classification")
WHOLES = ("schema_version", "singleton", "id", "supersedes_event_id")
FILLED = ("question", "evidence", "semantic_answer", "created_at")
FIELDS = {kind: {"record_type", *own} for kind, own in zip(PHASES, (("schema_version",), ("key", "value"), EVENT, SESSION), strict=True)}


def _taken_apart(line: str | None) -> tuple:
    """Whether a line is an object, and has just the fields of its kind; its texts and whole numbers; what of the rest is as it should be."""
    try:
        record = json.loads(line or "")
    except (ValueError, RecursionError):
        record = None
    if not isinstance(record, dict):
        return (False, False, *[None] * (len(TEXTS) + len(WHOLES) + len(FILLED) + 3))
    get = record.get
    texts = [v if type(v := get(f)) is str else None for f in TEXTS]
    wholes = [v if type(v := get(f)) is int and -(1 << 63) <= v < 1 << 63 else None for f in WHOLES]
    filled = [type(v := get(f)) is str and v != "" for f in FILLED]
    cursors = texts[0] == PHASES[3] and all((v := get(f, 0)) is None or (type(v) is str and v != "") for f in SESSION[1:])
    prior_typed = wholes[-1] is not None or get(WHOLES[-1], 0) is None
    return (True, record.keys() == FIELDS.get(texts[0]), *texts, *wholes, *filled, cursors, get("classification", 0) is None, prior_typed)


def records(lines: DataFrame) -> DataFrame:
    """Lines (log, line_no, value) of snapshots taken apart once, as the reader does: kind, and each field with whether it has its type.

    kind is null where a line is no JSON object or has no record type; exact tells whether a record has the fields of its kind
    and no others. Fields of other types than theirs are null.
    """
    flags = [*[f"good_{f}" for f in FILLED], "cursors", "unclassified", "prior_typed"]
    names = ["object", "exact", *TEXTS, *WHOLES, *flags]
    types = [pa.bool_()] * 2 + [pa.string()] * len(TEXTS) + [pa.int64()] * len(WHOLES) + [pa.bool_()] * len(flags)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = zip(*map(_taken_apart, batch.column("value").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("log"), batch.column("line_no"), *map(_array, columns, types)], names=["log", "line_no", *names])

    rows = lines.select("log", "line_no", "value")
    kinds = {pa.bool_(): "boolean", pa.string(): "string", pa.int64(): "long"}
    schema = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:2]] + [f"{n} {kinds[t]}" for n, t in zip(names, types, strict=True)]
    return scratch.table(rows.mapInArrow(apart, ", ".join(schema)).withColumnRenamed("record_type", "kind"), "snapshot_records")


def _array(values: tuple, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # halves of surrogate pairs, which no column can hold
        return pa.array([v and v.encode("utf-8", "replace").decode() for v in values], kind)


def event_violations(lines: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(check_id, line_no) of the rules that event lines (log, line_no, value) break, as rows; lines of other records are left out."""
    rows = records(lines)
    found = _violations(rows.where(F.col("kind") == PHASES[2]), _event_rules(rows, labels))
    return found.unionByName(_event_violations(rows)).select("check_id", "line_no")


def _event_rules(rows: DataFrame, labels: tuple[str, ...]) -> dict[str, Column]:
    """The rules of events that each line keeps or breaks by itself."""
    return {
        "event fields": F.col("exact"), "event id": F.col("id") > 0,
        "event action": F.col("action").isin("classify", "defer", "undo"), "event classification": F.when(F.col("action") == "classify", F.col("classification").isin(*labels)).otherwise(F.col("unclassified")),
        "superseded event": F.col("prior_typed") & ((F.col("action") != "undo") | F.col("supersedes_event_id").isNotNull()),
        "event passage_id": F.col("passage_id") != "", "event rubric_id": F.col("rubric_id") != "",
        **{f"event {c.removeprefix('good_')}": F.col(c) for c in rows.columns if c.startswith("good_")},
    }


def _event_violations(rows: DataFrame) -> DataFrame:
    """The rules of events that take other lines of the log, which are met by few of their columns."""
    rows = rows.where(F.col("kind") == PHASES[2])
    old = rows.where("id is not null").select("log", "line_no", "id", "action", "passage_id", "supersedes_event_id")
    ids = integrity.with_previous(rows.select("log", "line_no", "id"), "log", "line_no", "id", "before")
    order = _violations(ids, {"event order": F.col("before").isNull() | F.col("id").isNull() | (F.col("id") > F.col("before"))})
    return order.unionByName(integrity.dangling(old, "log").select(F.lit("superseded event is none of this passage").alias("check_id"), "log", "line_no"))


def _violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return integrity.violations(rows, F.struct("log", "line_no"), rules).select("check_id", "subject.log", "subject.line_no")


def violations(lines: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(check_id, log, line_no) of all rules of a snapshot that the lines of any number of logs break.

    The rules of validated(), each on its own: that a line is a record, that records stand in the order of their phases and
    header and session come once, the header's version, fields and keys of metadata and session, the events' rules, and that an
    event has the rubric that its log's metadata names. What a log lacks is told with its last line.
    """
    rows = records(lines)
    phase = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(PHASES)])
    rows = rows.withColumn("phase", phase)
    first = lambda condition: F.min(F.when(condition, F.col("line_no")))
    # Lines of the log come as numbers only, which are kept without sorting the records by log; the rubric is looked up among its few lines.
    logs = rows.groupBy("log").agg(
        F.array(*[first(F.col("phase") == i) for i in range(4)]).alias("firsts"), F.min("line_no").alias("top"), F.max("line_no").alias("last"),
        *[first((F.col("phase") == 1) & (F.col("key") == k)).alias(f"first_{k}") for k in METADATA],
    )
    rubrics = rows.where((F.col("kind") == PHASES[1]) & (F.col("key") == "rubric_id")).groupBy(F.col("log").alias("log_")).agg(F.min_by("value", "line_no").alias("rubric"))
    logs = scratch.table(logs.join(rubrics, F.col("log").eqNullSafe(F.col("log_")), "left").drop("log_"), "logs")
    lacks = {"header is missing": F.col("firsts")[0] == F.col("top"), "metadata is missing": F.col("first_corpus_fingerprint").isNotNull() & F.col("first_rubric_id").isNotNull(), "session state is missing": F.col("firsts")[3].isNotNull()}
    found = integrity.violations(logs, F.struct("log", F.col("last").alias("line_no")), lacks).select("check_id", "subject.log", "subject.line_no")

    known = rows.join(F.broadcast(logs.select(F.col("log").alias("log_"), "firsts", "rubric", *[f"first_{k}" for k in METADATA])), F.col("log").eqNullSafe(F.col("log_"))).drop("log_")
    of = lambda phase, rules: {name: F.when(F.col("phase") == phase, ok).otherwise(True) for name, ok in rules.items()}
    later = reduce(or_, [(F.col("phase") < k) & F.coalesce(F.col("firsts")[k] < F.col("line_no"), F.lit(False)) for k in range(1, 4)])
    again = F.col("phase").isin(0, 3) & (F.element_at("firsts", F.col("phase") + 1) < F.col("line_no"))
    rules = {
        "record": F.col("object"), "record type": ~F.col("object") | F.col("phase").isNotNull(), "record order": F.col("phase").isNull() | ~later, "record comes once": F.col("phase").isNull() | ~again,
        **of(0, {"header version": F.col("exact") & (F.col("schema_version") == 1)}),
        **of(1, {"metadata fields": F.col("exact") & (F.col("key") != "") & (F.col("value") != ""), "metadata key": reduce(or_, [(F.col("key") == k) & (F.col(f"first_{k}") == F.col("line_no")) for k in METADATA])}),
        **of(2, {"event rubric": F.col("rubric_id") == F.col("rubric"), **_event_rules(rows, labels)}),
        **of(3, {"session fields": F.col("exact") & (F.col("singleton") == 1), "session cursor": F.col("cursors")}),
    }
    return found.unionByName(_violations(known, rules)).unionByName(_event_violations(rows))


def lines_of(metadata: dict[str, str], events: list[dict], session: dict) -> list[str]:
    """Canonical lines in fixed order."""
    rows = [{"record_type": PHASES[0], "schema_version": 1}]
    rows += [{"record_type": PHASES[1], "key": k, "value": metadata[k]} for k in sorted(metadata)]
    rows += [{"record_type": PHASES[2], **{f: e[f] for f in EVENT}} for e in sorted(events, key=lambda e: e["id"])]
    rows.append({"record_type": PHASES[3], **session})
    return [canonical_line(r) for r in rows]


def file_lines(path: str | Path) -> list[str]:
    """The lines of a snapshot's file. Only line feeds end one: texts may hold other separators as they are."""
    with open(path, encoding="utf-8") as stream:
        return [line.removesuffix("\n") for line in stream]


def export(metadata: dict[str, str], events: DataFrame, session: dict, path: str | Path, labels: tuple[str, ...]) -> None:
    """Write a snapshot, read it back and check it, then put it in place in one step.

    The file is one human curator's log: it is written on the driver, row by row.
    """
    rows = [r.asDict() for r in events.orderBy("id").toLocalIterator()]
    text = lines_of(metadata, rows, session)
    validated(text, labels)
    stage = Path(f"{path}.partial")
    stage.write_text("".join(text), encoding="utf-8", newline="")
    validated(file_lines(stage), labels)
    os.replace(stage, path)


def load(spark: SparkSession, path: str | Path, labels: tuple[str, ...]) -> tuple[dict[str, str], DataFrame, dict]:
    metadata, events, session = validated(file_lines(path), labels)
    return metadata, spark.createDataFrame([tuple(e[f] for f in EVENT) for e in events], EVENTS_SCHEMA), session


def line_rows(metadata: dict[str, str], events: DataFrame, session: dict) -> DataFrame:
    """(phase, id, value): the canonical lines of a snapshot, without line ends; phase and id give their order."""
    spark = events.sparkSession
    around = [(0, 0, {"record_type": PHASES[0], "schema_version": 1})]
    around += [(1, i, {"record_type": PHASES[1], "key": k, "value": metadata[k]}) for i, k in enumerate(sorted(metadata))]
    around += [(3, 0, {"record_type": PHASES[3], **session})]
    fixed = spark.createDataFrame([(p, i, canonical_line(r)[:-1]) for p, i, r in around], "phase int, id long, value string")
    line = canonical_json(record_type=F.lit(PHASES[2]), **{f: F.col(f) for f in EVENT})
    return fixed.unionByName(events.select(F.lit(2).alias("phase"), F.col("id").cast("long").alias("id"), line.alias("value")))


def write_parts(metadata: dict[str, str], events: DataFrame, session: dict, path: str, labels: tuple[str, ...]) -> tuple[dict[str, str], DataFrame, dict]:
    """Write a snapshot of any length as parts, in a new folder, that one after another are the file of export(); then read it back.

    Lines are dealt by ranges of their order, so each part is a task's. What read_parts makes of them, every line checked, is
    returned. A snapshot that breaks a rule is removed, and SnapshotError raised.
    """
    spark = events.sparkSession
    rows = line_rows(metadata, events, session).repartitionByRange("phase", "id").sortWithinPartitions("phase", "id")
    rows.select("value").write.text(path)
    try:
        return read_parts(spark, path, labels)
    except SnapshotError:
        scratch.remove(spark, path)
        raise


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(log, line_no, value) of the lines of a folder's parts in order; log is the folder.

    Parts follow each other by name, and readers may split them. Each split numbers its own lines; what is ahead of it comes from
    a table with a row for each split.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    rows = scratch.table(rows, "lines")
    sizes = rows.groupBy(F.col("file").alias("file_"), F.col("block").alias("block_")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("file_", "block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("file_", "block_", "first", ahead.alias("ahead"))
    rows = rows.join(F.broadcast(sizes), (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    return rows.select(F.lit(path).alias("log"), (F.col("ahead") + F.col("at") - F.col("first") + 1).alias("line_no"), "value")


def read_parts(spark: SparkSession, path: str, labels: tuple[str, ...]) -> tuple[dict[str, str], DataFrame, dict]:
    """(metadata, events, session) of a snapshot in parts, whatever its length; SnapshotError for the first line that breaks a rule.

    Rules are checked as rows; what comes to the driver is the first fault, the metadata and the session.
    """
    lines = numbered_lines(spark, path)
    worst = violations(lines, labels).agg(F.min(F.struct("line_no", "check_id")).alias("x")).first()["x"]
    if worst is not None:
        raise SnapshotError(f"line {worst['line_no']}: {worst['check_id']}")
    kind = F.get_json_object("value", "$.record_type")
    few = [json.loads(r["value"]) for r in lines.where(kind.isin(PHASES[1], PHASES[3])).select("value").collect()]  # one for each key, and the session
    metadata = {r["key"]: r["value"] for r in few if r["record_type"] == PHASES[1]}
    session = next({k: r[k] for k in SESSION} for r in few if r["record_type"] == PHASES[3])
    events = lines.where(kind == PHASES[2]).select(F.from_json("value", EVENTS_SCHEMA).alias("e")).select("e.*")
    return metadata, events.select(*EVENT), session
