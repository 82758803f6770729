"""Curation state in a SQLite file: what a single curator's session reads and writes.

Spark reads it as frames; decisions are appended with the cursor that follows them in one transaction.
"""

from __future__ import annotations

import os
import sqlite3
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import snapshot

# The tables of the format, with their columns.
TABLES = {
    "curation_meta": ("key", "value"),
    "audit_events": snapshot.EVENT,
    "session_state": snapshot.SESSION,
}
_KINDS = {"id": "INTEGER PRIMARY KEY", "supersedes_event_id": "INTEGER REFERENCES audit_events(id)", "singleton": "INTEGER PRIMARY KEY CHECK (singleton = 1)", "key": "TEXT PRIMARY KEY"}
_OPTIONAL = {"classification", *snapshot.SESSION[1:]}
CURSORS = {"undecided": snapshot.SESSION[2], "deferred": snapshot.SESSION[3]}


class StateError(ValueError):
    pass


def _columns(db: sqlite3.Connection, table: str) -> tuple[str, ...]:
    return tuple(r[1] for r in db.execute(f"PRAGMA table_info({table})"))


def layout_violations(path: Path) -> list[tuple[str, str]]:
    """(check_id, table) of tables that lack columns, have others, or have them in another order."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        return [("columns", t) for t, columns in TABLES.items() if _columns(db, t) != columns]
    finally:
        db.close()


def create(path: Path, metadata: dict[str, str]) -> None:
    """A state without events; FileExistsError where something is."""
    _fill(path, metadata, [], dict(zip(snapshot.SESSION, (1, None, None, None), strict=True)))


def _fill(path: Path, metadata: dict[str, str], events: list[dict], session: dict) -> None:
    """Write a whole state beside its place, check its references, then link it there; nothing is overwritten."""
    stage = path.with_name(f".{path.name}.{os.getpid()}")
    stage.unlink(missing_ok=True)
    db = sqlite3.connect(stage)
    try:
        db.execute("PRAGMA foreign_keys = ON")
        with db:
            for table, columns in TABLES.items():
                db.execute(f"CREATE TABLE {table} ({', '.join(f'{c} {_KINDS.get(c, 'TEXT' if c in _OPTIONAL else 'TEXT NOT NULL')}' for c in columns)})")
            for table, rows in (("curation_meta", [{"key": k, "value": v} for k, v in metadata.items()]), ("audit_events", events), ("session_state", [session])):
                columns = TABLES[table]
                db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(columns))})", [tuple(r[c] for c in columns) for r in rows])
        if db.execute("PRAGMA foreign_key_check").fetchall() or db.execute("PRAGMA integrity_check").fetchone() != ("ok",):
            raise StateError("state is not sound")
        db.close()
        os.link(stage, path)
    finally:
        db.close()
        stage.unlink(missing_ok=True)


def load(path: Path, lines: list[str], labels: tuple[str, ...]) -> None:
    """A fresh state from the lines of a snapshot."""
    _fill(path, *snapshot.validated(lines, labels))


def read(path: Path) -> tuple[dict[str, str], list[dict], dict]:
    """(metadata, events, session) of a state, all in one transaction."""
    if bad := layout_violations(path):
        raise StateError(f"unexpected columns in {bad[0][1]}")
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True, isolation_level=None)
    try:
        db.execute("BEGIN")
        metadata = dict(db.execute("SELECT key, value FROM curation_meta ORDER BY key"))
        events = [dict(zip(snapshot.EVENT, r, strict=True)) for r in db.execute(f"SELECT {', '.join(snapshot.EVENT)} FROM audit_events ORDER BY id")]
        session = db.execute(f"SELECT {', '.join(snapshot.SESSION)} FROM session_state WHERE singleton = 1").fetchone()
    finally:
        db.close()
    if session is None:
        raise StateError("session state is missing")
    return metadata, events, dict(zip(snapshot.SESSION, session, strict=True))


def events(spark: SparkSession, path: Path) -> DataFrame:
    return spark.createDataFrame([tuple(e[f] for f in snapshot.EVENT) for e in read(path)[1]], snapshot.EVENTS_SCHEMA)


def export(path: Path, output: Path, labels: tuple[str, ...]) -> None:
    """The state as a snapshot, checked before it takes its place."""
    lines = snapshot.lines_of(*read(path))
    snapshot.validated(lines, labels)
    stage = output.with_name(f".{output.name}.{os.getpid()}")
    stage.write_text("".join(lines), encoding="utf-8", newline="")
    os.replace(stage, output)


def upgrade(path: Path) -> None:
    """Give a state of one cursor the cursors of both modes; the old cursor is where the undecided one begins."""
    db = sqlite3.connect(path)
    try:
        with db:
            have = _columns(db, "session_state")
            for column in (c for c in snapshot.SESSION if c not in have):
                db.execute(f"ALTER TABLE session_state ADD COLUMN {column} TEXT")
                if column == CURSORS["undecided"]:
                    db.execute(f"UPDATE session_state SET {column} = {snapshot.SESSION[1]}")
    finally:
        db.close()


def bind(path: Path, fingerprint: str, rubric: str) -> None:
    """Make a state for this corpus and rubric, or refuse one that belongs to another."""
    if not path.exists():
        create(path, {"corpus_fingerprint": fingerprint, "rubric_id": rubric})
    upgrade(path)
    metadata = read(path)[0]
    if metadata.get("corpus_fingerprint") != fingerprint:
        raise StateError("state belongs to another corpus")
    if metadata.get("rubric_id") != rubric:
        raise StateError("state belongs to another rubric")


def record(path: Path, event: dict, cursor: str | None, mode: str = "undecided") -> int:
    """Append a decision with what it replaces, and move the mode's cursor, both or neither; the event's id.

    A classify or defer event takes the place of the passage's active event before it. An undo takes back the
    latest active event of all, and gives 0, writing nothing, where there is none.
    """
    active = "FROM audit_events e WHERE action <> 'undo' AND NOT EXISTS (SELECT 1 FROM audit_events u WHERE u.action = 'undo' AND u.supersedes_event_id = e.id)"
    db = sqlite3.connect(path)
    try:
        with db:
            db.execute("BEGIN IMMEDIATE")
            if event["action"] == "undo":
                last = db.execute(f"SELECT id, passage_id {active} ORDER BY id DESC LIMIT 1").fetchone()
                if last is None:
                    return 0
                event = event | {"supersedes_event_id": last[0], "passage_id": last[1], "classification": None}
                cursor = last[1]
            else:
                last = db.execute(f"SELECT max(id) {active} AND passage_id = ?", (event["passage_id"],)).fetchone()
                event = event | {"supersedes_event_id": last[0]}
            columns = snapshot.EVENT[1:]
            made = db.execute(f"INSERT INTO audit_events ({', '.join(columns)}) VALUES ({', '.join('?' * len(columns))})", tuple(event.get(c) for c in columns)).lastrowid
            db.execute(f"UPDATE session_state SET {CURSORS[mode]} = ?", (cursor,))
            return made
    finally:
        db.close()
