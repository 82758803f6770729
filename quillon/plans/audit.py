"""Queries on decision logs, cursors and constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import curation, integrity
from ..sources import snapshot
from .corpus import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_LOG = """
log AS (SELECT event_id AS id, user_id AS passage_id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'view' THEN 'defer' ELSE 'classify' END AS action, event_type AS classification,
  CASE WHEN event_type = 'error' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) END AS supersedes FROM events),
active AS (SELECT * FROM log WHERE action <> 'undo' AND NOT EXISTS (SELECT 1 FROM log u WHERE u.action = 'undo' AND u.supersedes = log.id)),
effective AS (SELECT passage_id, max(id) AS id, arg_max(action, id) AS action, arg_max(classification, id) AS classification FROM active GROUP BY 1)
"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a decision log: users are passages, an error undoes the user's event before it."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    action = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "defer").otherwise("classify")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("passage_id"), action.alias("action"), F.col("event_type").alias("classification"), F.when(F.col("event_type") == "error", F.lag("event_id").over(w)).alias("supersedes_event_id"))


@query("WITH " + _LOG + "SELECT passage_id, id, action, classification FROM effective")
def effective_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.effective(_log(spark, sf_dir)).select("passage_id", "id", "action", "classification")


@query("WITH " + _LOG + "SELECT id, passage_id, action, classification FROM active ORDER BY id DESC LIMIT 1")
def latest_active_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.latest_active(_log(spark, sf_dir)).select("id", "passage_id", "action", "classification")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS undo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, false AS undo, NULL::BIGINT AS undone_id, CAST([] AS BIGINT[]) AS stack FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT s.user_id, e.k, e.event_id, e.undo, CASE WHEN e.undo AND len(s.stack) > 0 THEN s.stack[-1] END, CASE WHEN NOT e.undo THEN list_append(s.stack, e.event_id) WHEN len(s.stack) > 0 THEN s.stack[:len(s.stack) - 1] ELSE s.stack END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1)
SELECT event_id AS id, user_id, undone_id FROM s WHERE undo""")
def undo_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("undo"))
    return curation.undo_pairs(rows, "user_id").where("undo").select("id", "user_id", "undone_id")


_DECIDED = "CASE WHEN toxic = 1 THEN 'analysis or reception' WHEN quality = 1 THEN 'internal lore' ELSE 'deferred' END"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "analysis or reception").when(F.col("quality") == 1, "internal lore").otherwise("deferred")
    return read(spark, sf_dir, "labels").select("doc_id", label.alias("label"))


@query(f"""WITH names AS (SELECT unnest(range(8)) AS ord, unnest(['internal lore', 'external creation history', 'analysis or reception', 'adaptation material', 'reference or administrative material', 'deferred', 'undecided', 'total']) AS label),
got AS (SELECT {_DECIDED} AS label, count(*) AS n FROM labels GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM documents UNION ALL SELECT 'undecided', (SELECT count(*) FROM documents) - (SELECT count(*) FROM labels))
SELECT ord, label, coalesce(n, 0) AS n FROM names LEFT JOIN got USING (label)""")
def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = read(spark, sf_dir, "documents").count()
    return curation.counts(_decided(spark, sf_dir), total, list(curation.CLASSIFICATIONS.values()))


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def undecided_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.undecided(read(spark, sf_dir, "documents").select("doc_id", "source"), _decided(spark, sf_dir), "doc_id")


@query("""SELECT conv_id, turn, coalesce(array_to_string(list(role || turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ','), '') AS previous,
coalesce(array_to_string(list(role || turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ','), '') AS following FROM conversations""")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat("role", "turn").alias("tag"))
    rows = curation.context(rows, "conv_id", "turn", "tag", 2, 2)
    return rows.select("conv_id", "turn", F.array_join("previous", ",").alias("previous"), F.array_join("following", ",").alias("following"))


@query("""SELECT conv_id, turn, dense_rank() OVER (ORDER BY conv_id) AS group_no, (SELECT count(DISTINCT conv_id) FROM conversations) AS groups, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS passage_no,
count(*) OVER (PARTITION BY conv_id) AS passages, row_number() OVER (ORDER BY conv_id, turn) AS overall_no, count(*) OVER () AS all_passages FROM conversations""")
def progress_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = curation.progress(read(spark, sf_dir, "conversations").select("conv_id", "turn"), "conv_id", "turn")
    return rows.select("conv_id", "turn", "group_no", "groups", "passage_no", "passages", "overall_no", "all_passages")


@query("""WITH o AS (SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)), c AS (SELECT doc_id FROM documents WHERE doc_id % 100 = 0)
SELECT c.doc_id AS cursor, coalesce(min(o.doc_id), (SELECT min(doc_id) FROM o)) AS next_open FROM c LEFT JOIN o ON o.doc_id > c.doc_id GROUP BY c.doc_id""")
def next_undecided_circular(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    open_ = curation.undecided(docs, _decided(spark, sf_dir), "doc_id")
    return curation.next_after(docs, open_, docs.where("doc_id % 100 = 0"), "doc_id")


@query("SELECT event_id, user_id FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value <= before")
def id_monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.out_of_order(read(spark, sf_dir, "events"), "user_id", "event_id", "value").select("event_id", "user_id")


@query("""SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS t0, lag(ts) OVER w AS at0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
WHERE event_type = t0 AND epoch(ts) - epoch(at0) < 40000""")
def key_repeat_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.col("ts").cast("timestamp")
    rows = read(spark, sf_dir, "events").withColumns({"t0": F.lag("event_type").over(w), "at0": F.lag(at).over(w)})
    return rows.where(T.repeat_refused(F.col("event_type"), F.col("t0"), at, F.col("at0"), 40000)).select("event_id", "user_id", "event_type")


@query("""WITH z AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' WHEN 2 THEN '' ELSE ' UTC' END AS stamp FROM events)
SELECT event_id % 4 AS kind, count(*) AS n, count_if(regexp_matches(stamp, '^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2})?(Z|[+-][0-9]{2}:[0-9]{2})$')) AS valid FROM z GROUP BY 1""")
def timestamp_zone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("event_id") % 4 == 0, "Z").when(F.col("event_id") % 4 == 1, "+02:00").when(F.col("event_id") % 4 == 2, "").otherwise(" UTC")
    rows = read(spark, sf_dir, "events").select((F.col("event_id") % 4).alias("kind"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone).alias("stamp"))
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(integrity.zoned_timestamp(F.col("stamp"))).alias("valid"))


@query("""WITH e AS (SELECT event_id AS n, user_id, event_type, event_id + 1 AS id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'view' THEN 'defer' ELSE 'classify' END AS act,
  CASE WHEN event_type = 'error' AND event_id % 13 = 0 THEN NULL WHEN event_type = 'error' THEN event_id ELSE NULL END AS prior FROM events),
j AS (SELECT n, user_id, CASE WHEN n % 41 <> 0 THEN id END AS id, CASE WHEN n % 43 = 0 THEN 'remove' ELSE act END AS action, act, prior, 'p' || user_id AS passage FROM e),
o AS (SELECT *, lag(CASE WHEN n % 37 = 0 THEN id - 5 ELSE id END) OVER (ORDER BY n) AS before, CASE WHEN n % 37 = 0 THEN id - 5 ELSE id END AS own FROM j),
v AS (SELECT 'event id' AS check_id, n FROM o WHERE own IS NULL OR own <= 0 UNION ALL SELECT 'event order', n FROM o WHERE own <= before UNION ALL SELECT 'event action', n FROM o WHERE action = 'remove'
  UNION ALL SELECT 'event classification', n FROM o WHERE (action = 'classify' AND n % 17 = 0) OR (action <> 'classify' AND (act = 'classify') ) UNION ALL SELECT 'superseded event', n FROM o WHERE action = 'undo' AND prior IS NULL
  UNION ALL SELECT 'event question', n FROM o WHERE n % 19 = 0 UNION ALL SELECT 'event evidence', n FROM o WHERE n % 23 = 0 UNION ALL SELECT 'event fields', n FROM o WHERE n % 29 = 0
  UNION ALL SELECT 'superseded event is none of this passage', n FROM o WHERE own IS NOT NULL AND prior IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o q WHERE q.own = o.prior AND q.own < o.own AND q.passage = o.passage AND q.action <> 'undo'))
SELECT check_id, count(*) AS n, min(n) AS first_line FROM v GROUP BY 1""")
def schema_violation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as lines of a snapshot with faults that follow from their numbers: how often each rule is broken, and where first."""
    n, kind = F.col("event_id"), F.col("event_type")
    act = F.when(kind == "error", "undo").when(kind == "view", "defer").otherwise("classify")
    own = n + 1 - F.when(n % 37 == 0, 5).otherwise(0)
    label = F.when(act == "classify", F.when(n % 17 == 0, "x").otherwise("internal lore"))
    fields = {
        "record_type": F.lit("audit_event"), "action": F.when(n % 43 == 0, "remove").otherwise(act), "passage_id": F.concat(F.lit("p"), "user_id"), "classification": label, "rubric_id": F.lit("r1"), "question": F.when(n % 19 == 0, "").otherwise("q"),
        "evidence": F.when(n % 23 != 0, F.lit("e")), "semantic_answer": F.lit("s"), "created_at": F.lit("2026-01-01T00:00:00Z"), "supersedes_event_id": F.when((kind == "error") & (n % 13 != 0), n),
    }
    line = F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})
    # The id is written as a text in some lines; others have a field more.
    ident = F.concat(F.lit('{"id":'), F.when(n % 41 == 0, F.concat(F.lit('"'), own, F.lit('"'))).otherwise(own.cast("string")), F.when(n % 29 == 0, ',"extra":1').otherwise(""), F.lit(","))
    lines = read(spark, sf_dir, "events").select(F.lit("one").alias("log"), n.alias("line_no"), F.concat(ident, F.substring(line, 2, 1 << 20)).alias("value"))
    found = snapshot.event_violations(lines, tuple(curation.CLASSIFICATIONS.values()))
    return found.groupBy("check_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@query("""
WITH e AS (SELECT event_id AS n, user_id % 8 AS k FROM events), logs AS (SELECT DISTINCT k FROM e),
lines AS (SELECT k, 10 + n AS line_no, CASE WHEN n % 59 = 0 THEN 'none' WHEN n % 53 = 0 THEN 'other' ELSE 'event' END AS kind, n FROM e),
v AS (SELECT 'record' AS check_id, k FROM lines WHERE kind = 'none' UNION ALL SELECT 'record type', k FROM lines WHERE kind = 'other'
  UNION ALL SELECT 'event rubric', k FROM lines WHERE kind = 'event' AND (k = 4 OR n % 31 = 0) UNION ALL SELECT 'record order', k FROM lines WHERE kind = 'event' AND k = 7
  UNION ALL SELECT 'event classification', k FROM lines WHERE kind = 'event' AND n % 17 = 0
  UNION ALL SELECT unnest(CASE k WHEN 0 THEN ['record comes once'] WHEN 1 THEN ['header version', 'session fields'] WHEN 2 THEN ['header is missing'] WHEN 3 THEN ['metadata fields', 'session cursor'] WHEN 4 THEN ['metadata is missing']
    WHEN 5 THEN ['metadata key'] WHEN 6 THEN ['metadata key', 'session state is missing'] END), k FROM logs)
SELECT 'log ' || k AS log, check_id, count(*) AS n FROM v GROUP BY ALL""")
def snapshot_rule_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as eight logs in whole snapshots, each with a fault of its own in header, metadata, session or order: rules broken in each."""
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("n"), (F.col("user_id") % 8).alias("k"))
    n, k = F.col("n"), F.col("k")
    body = F.concat(F.lit('{"record_type":"audit_event","action":"classify","passage_id":"p","question":"q","evidence":"e","semantic_answer":"s","created_at":"c","supersedes_event_id":null,"id":'), n + 1, F.lit(',"rubric_id":"'), F.when(n % 31 == 0, "r0").otherwise("r1"), F.lit('","classification":"'), F.when(n % 17 == 0, "x").otherwise("internal lore"), F.lit('"}'))
    body = F.when(n % 59 == 0, '["no object"]').when(n % 53 == 0, '{"record_type":"else"}').otherwise(body)
    # Dealt out evenly while rows are narrow: the file's groups of rows may be fewer than cores, and lines cost much more than rows.
    lines = events.repartition("n").select(k.alias("k"), (n + 10).alias("line_no"), body.alias("value"))
    header = '{"record_type":"curation_snapshot","schema_version":%d}'
    entry = '{"record_type":"metadata","key":"%s","value":"%s"}'
    session = '{"record_type":"session_state","singleton":%s,"current_passage_id":"p","current_undecided_passage_id":null,"current_deferred_passage_id":%s}'
    around = []  # of each log the lines around its events
    for i in range(8):
        around += [(i, 1, header % (2 if i == 1 else 1))] if i != 2 else []
        around += [(i, 2, entry % ("corpus_fingerprint", "" if i == 3 else "f"))]
        around += [(i, 3, entry % ("rubric_id", "r1"))] if i != 4 else []
        around += [(i, 4, entry % ("rubric_id" if i == 5 else "else", "r2"))] if i in (5, 6) else []
        around += [(i, 5 if i == 7 else 1 << 40, session % ("true" if i == 1 else "1", '""' if i == 3 else "null"))] if i != 6 else []
        around += [(i, 1 << 41, session % ("1", "null"))] if i == 0 else []
    around = spark.createDataFrame(around, "k long, line_no long, value string").join(events.select("k").distinct(), "k", "left_semi")
    found = snapshot.violations(lines.unionByName(around).select(F.concat(F.lit("log "), "k").alias("log"), "line_no", "value"), tuple(curation.CLASSIFICATIONS.values()))
    return found.groupBy("log", "check_id").agg(F.count("*").alias("n"))
