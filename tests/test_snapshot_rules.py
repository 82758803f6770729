"""Rules of snapshots as rows: a snapshot has a violation exactly when the reader refuses it."""

from __future__ import annotations

import json

import pytest

from quillon.operators import integrity
from quillon.sources import snapshot

LABELS = ("lore", "analysis")


def event(i, **more):
    fields = {"record_type": "audit_event", "id": i, "action": "classify", "passage_id": "p", "classification": "lore", "rubric_id": "r", "question": "q", "evidence": "e", "semantic_answer": "s", "created_at": "c", "supersedes_event_id": None}
    return fields | more


HEADER = {"record_type": "curation_snapshot", "schema_version": 1}
MARK, RUBRIC = {"record_type": "metadata", "key": "corpus_fingerprint", "value": "f"}, {"record_type": "metadata", "key": "rubric_id", "value": "r"}
END = {"record_type": "session_state", "singleton": 1, "current_passage_id": None, "current_undecided_passage_id": "p", "current_deferred_passage_id": None}
UNDO = {"action": "undo", "classification": None}
WHOLE = {
    "plain": [HEADER, MARK, RUBRIC, event(1), event(2, action="defer", classification=None), event(5, **UNDO, supersedes_event_id=2), event(6, supersedes_event_id=1), END],
    "no events": [HEADER, RUBRIC, MARK, END],
}
FAULTY = {
    "no header": [MARK, RUBRIC, END], "version": [{**HEADER, "schema_version": 2}, MARK, RUBRIC, END], "version true": [{**HEADER, "schema_version": True}, MARK, RUBRIC, END], "header field": [{**HEADER, "x": 1}, MARK, RUBRIC, END],
    "two headers": [HEADER, HEADER, MARK, RUBRIC, END], "late metadata": [HEADER, MARK, event(1), RUBRIC, END], "key": [HEADER, MARK, RUBRIC, {**MARK, "key": "z"}, END], "repeated key": [HEADER, MARK, RUBRIC, MARK, END],
    "empty value": [HEADER, {**MARK, "value": ""}, RUBRIC, END], "value type": [HEADER, {**MARK, "value": 1}, RUBRIC, END], "metadata field": [HEADER, {**MARK, "x": 1}, RUBRIC, END], "no rubric": [HEADER, MARK, END],
    "no session": [HEADER, MARK, RUBRIC], "two sessions": [HEADER, MARK, RUBRIC, END, END], "event after session": [HEADER, MARK, RUBRIC, END, event(1)], "singleton": [HEADER, MARK, RUBRIC, {**END, "singleton": True}],
    "cursor": [HEADER, MARK, RUBRIC, {**END, "current_passage_id": ""}], "cursor type": [HEADER, MARK, RUBRIC, {**END, "current_passage_id": 3}], "session field": [HEADER, MARK, RUBRIC, {k: v for k, v in END.items() if k != "current_passage_id"}],
    "other rubric": [HEADER, MARK, RUBRIC, event(1, rubric_id="z"), END], "label": [HEADER, MARK, RUBRIC, event(1, classification="z"), END], "order": [HEADER, MARK, RUBRIC, event(2), event(1), END], "id": [HEADER, MARK, RUBRIC, event(0), END],
    "id type": [HEADER, MARK, RUBRIC, event("1"), END], "deferred label": [HEADER, MARK, RUBRIC, event(1, action="defer"), END], "action": [HEADER, MARK, RUBRIC, event(1, action="z"), END], "empty": [HEADER, MARK, RUBRIC, event(1, evidence=""), END],
    "undo of nothing": [HEADER, MARK, RUBRIC, event(1, **UNDO), END], "undo of another passage": [HEADER, MARK, RUBRIC, event(1), event(2, **UNDO, passage_id="q", supersedes_event_id=1), END], "undo of an undo": [HEADER, MARK, RUBRIC, event(1), event(2, **UNDO, supersedes_event_id=1), event(3, **UNDO, supersedes_event_id=2), END],
    "no type": [HEADER, MARK, RUBRIC, {"x": 1}, END], "unknown type": [HEADER, MARK, RUBRIC, {"record_type": "z"}, END], "a list": [HEADER, MARK, RUBRIC, [1], END], "field": [HEADER, MARK, RUBRIC, event(1, x=1), END], "number": [HEADER, MARK, RUBRIC, 7, END],
}


def test_rows_and_reader_agree(spark):
    every = {**WHOLE, **FAULTY}
    lines = [(name, i, json.dumps(r)) for name, records in every.items() for i, r in enumerate(records, 1)] + [("no json", 1, json.dumps(HEADER)), ("no json", 2, "{")]
    found: dict[str, set] = {}
    for r in snapshot.violations(spark.createDataFrame(lines, "log string, line_no long, value string"), LABELS).collect():
        found.setdefault(r["log"], set()).add(r["check_id"])
    for name, records in every.items():
        texts = [json.dumps(r) for r in records]
        if name in WHOLE:
            snapshot.validated(texts, LABELS)
            assert name not in found, (name, found[name])
        else:
            with pytest.raises(snapshot.SnapshotError):
                snapshot.validated(texts, LABELS)
            assert found.get(name), name
    assert "record" in found["no json"] and found["two headers"] == {"record comes once"} and found["other rubric"] == {"event rubric"}


def test_parts_are_the_file_and_come_back(spark, tmp_path):
    odd = "".join(map(chr, range(32))) + "\x7f é王🙂\u2028\x85 \\u001F \\\x0b \\\\\x1f\"/"
    events = [event(i, question=f"{odd}{i}", passage_id=f"p{i % 7}", **({"action": "defer", "classification": None} if i % 3 == 0 else {})) for i in range(1, 400)]
    events += [event(400, **UNDO, passage_id="p1", supersedes_event_id=1)]
    rows = spark.createDataFrame([tuple(e[f] for f in snapshot.EVENT) for e in events], snapshot.EVENTS_SCHEMA).repartition(5)
    metadata, session = {"rubric_id": "r", "corpus_fingerprint": "f"}, {k: v for k, v in END.items() if k != "record_type"}
    snapshot.export(metadata, rows, session, tmp_path / "one.jsonl", LABELS)
    folder = tmp_path / "parts"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")  # parts are read in splits
    try:
        snapshot.write_parts(metadata, rows, session, str(folder), LABELS)
        parts = sorted(p for p in folder.iterdir() if p.name.startswith("part-"))
        assert b"".join(p.read_bytes() for p in parts) == (tmp_path / "one.jsonl").read_bytes()
        got = snapshot.read_parts(spark, str(folder), LABELS)
        assert got[0] == metadata and got[2] == session and sorted(map(tuple, got[1].collect())) == sorted(map(tuple, rows.collect()))
        numbers = {r["line_no"]: r["value"] for r in snapshot.numbered_lines(spark, str(folder)).collect()}
        assert [numbers[i + 1] for i in range(len(numbers))] == (tmp_path / "one.jsonl").read_text(encoding="utf-8", newline="").split("\n")[:-1]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(snapshot.SnapshotError, match="line 4: event rubric"):
        snapshot.write_parts({**metadata, "rubric_id": "z"}, rows, session, str(tmp_path / "bad"), LABELS)
    assert not (tmp_path / "bad").exists()


def test_odd_fields_and_reader_agree(spark):
    """Fields that are objects, arrays, numbers with a point, of other case, or dotted, where others are meant."""
    changes = [{"id": {"id": 1}}, {"id": 1.0}, {"id": 1e3}, {"id": True}, {"question": ["q"]}, {"passage_id": {"a": "p"}}, {"classification": {}}, {"supersedes_event_id": 1.5}, {"supersedes_event_id": "1"}, {"action": None}, {"created_at": 7}]
    odd = {f"event {c}": [HEADER, MARK, RUBRIC, event(1) | c, END] for c in changes}
    odd |= {"case": [HEADER, MARK, RUBRIC, {("ID" if k == "id" else k): v for k, v in event(1).items()}, END], "dotted": [HEADER, MARK, RUBRIC, {("x.id" if k == "id" else k): v for k, v in event(1).items()}, END]}
    odd |= {"type object": [HEADER, MARK, RUBRIC, event(1), {**END, "record_type": {"record_type": "session_state"}}], "key object": [HEADER, {**MARK, "key": {"key": "corpus_fingerprint"}}, RUBRIC, END]}
    rows = spark.createDataFrame([(name, i, json.dumps(r)) for name, records in (odd | WHOLE).items() for i, r in enumerate(records, 1)], "log string, line_no long, value string")
    assert {r["log"] for r in snapshot.violations(rows, LABELS).collect()} == set(odd)
    for name, records in odd.items():
        with pytest.raises(snapshot.SnapshotError):
            snapshot.validated([json.dumps(r) for r in records], LABELS)


def test_writing_gives_what_was_read_back_and_lines_stay_in_place(spark, tmp_path):
    rows = spark.createDataFrame([tuple(event(i)[f] for f in snapshot.EVENT) for i in range(1, 50)], snapshot.EVENTS_SCHEMA)
    metadata, session = {"rubric_id": "r", "corpus_fingerprint": "f"}, {k: v for k, v in END.items() if k != "record_type"}
    got = snapshot.write_parts(metadata, rows, session, str(tmp_path / "parts"), LABELS)  # so nobody has to read and check it twice
    assert got[0] == metadata and got[2] == session and sorted(map(tuple, got[1].collect())) == sorted(map(tuple, rows.collect()))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # numbers are carried to the lines, not lines to a task for each split
        plan = snapshot.numbered_lines(spark, str(tmp_path / "parts"))._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_rules_take_few_passes_over_the_records(spark):
    lines = spark.createDataFrame([("a", i, json.dumps(r)) for i, r in enumerate(WHOLE["plain"], 1)], "log string, line_no long, value string")
    plan = snapshot.violations(lines, LABELS)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 7 and snapshot.violations(lines, LABELS).isEmpty()


def test_lines_are_taken_apart_as_the_reader_does(spark):
    """What ends behind a record, fields that come twice, halves of characters, numbers beyond a long, and lines that are nothing."""
    good, last = [json.dumps(r) for r in (HEADER, MARK, RUBRIC)], json.dumps(END)
    plain = json.dumps(event(1))
    odd = {"rest behind": plain + " x", "twice": plain[:-1] + ', "evidence": ""}', "twice and right": '{"evidence": "", ' + plain[1:], "half": plain.replace('"q"', '"\\ud800"'), "half passage": plain.replace('"p"', '"\\udc00"'), "nan": plain.replace('"q"', "NaN"), "blank": "", "null": "null"}
    rows = [(name, i, text) for name, text in odd.items() for i, text in enumerate([*good, text, last], 1)]
    rows += [("none", i, text) for i, text in enumerate([*good, None, last], 1)] + [("deep", i, text) for i, text in enumerate([*good, "[" * 200000, last], 1)]
    found = {r["log"] for r in snapshot.violations(spark.createDataFrame(rows, "log string, line_no long, value string"), LABELS).collect()}
    for name, text in odd.items():
        try:
            snapshot.validated([*good, text, last], LABELS)
            assert name not in found, name
        except snapshot.SnapshotError:
            assert name in found, name
    assert {"none", "deep", "rest behind", "twice"} <= found and not {"twice and right", "half", "half passage"} & found


def test_order_is_told_without_a_join(spark):
    rows = spark.createDataFrame([("g", i, i) for i in range(5)], "g string, o long, v long")
    plan = integrity.with_previous(rows, "g", "o", "v", "before", 2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan  # rows are dealt once, to the windows
