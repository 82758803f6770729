"""Queries on retrieval, decisions with scopes, activation of releases and blinded evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import scratch
from ..operators import activation, evaluation, integrity, merkle, retrieval, scopes
from ..sources import dump_index
from .corpus import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BLOCK_WIDTH = 128  # the tables are small; the library's own width is for corpora


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_BM25 = r"""
passages AS (SELECT doc_id AS ordinal, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)),
stats AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM passages),
found AS (SELECT ordinal, len(w) AS length, unnest(w) AS term FROM passages),
counted AS (SELECT ordinal, length, term, count(*) AS tf FROM found GROUP BY ALL),
frequency AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
impacts AS (SELECT ordinal, term, round(1000000 * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * length / mean)))::BIGINT AS impact FROM counted JOIN frequency USING (term), stats),
questions AS (SELECT 'b' || item_id AS question_id, text FROM benchmark UNION ALL SELECT 'd' || doc_id, split_part(text, E'\n', 1) FROM documents WHERE doc_id % 100 = 0),
asked AS (SELECT question_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS term FROM questions),
scores AS (SELECT question_id, ordinal, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (term) GROUP BY ALL)
"""


def _passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", "text").join(good, "doc_id", "left_semi").select(F.col("doc_id").alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("doc_id % 100 = 0")
    own = docs.select(F.concat(F.lit("d"), "doc_id").alias("question_id"), F.substring_index("text", "\n", 1).alias("text"))
    return read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), "item_id").alias("question_id"), "text").unionByName(own)


def _opened(spark: SparkSession, sf_dir: str) -> retrieval.Retrieval:
    """The documents of good quality as the only release, activated and indexed."""
    registry, folder = scratch.new_path(spark, "registry"), scratch.new_path(spark, "index")
    activation.activate(spark, registry, "good-documents", 0, {"good-documents"})
    retrieval.write_index(_passages(spark, sf_dir), "good-documents", folder, BLOCK_WIDTH)
    return retrieval.Retrieval.open(spark, folder, registry)


@query("WITH " + _BM25 + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, ordinal) AS rank FROM scores)
SELECT question_id, rank, ordinal, score FROM ranked WHERE rank <= 10""")
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items, and first lines of every hundredth document, as questions to the active release."""
    return _opened(spark, sf_dir).search(_questions(spark, sf_dir), 10)


@query("WITH " + _BM25 + f""", best AS (SELECT term, ordinal // {BLOCK_WIDTH} AS block, max(impact) AS best FROM impacts GROUP BY ALL),
bounds AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY bound DESC, block) AS place FROM (SELECT question_id, block, sum(best) AS bound FROM asked JOIN best USING (term) GROUP BY ALL)),
lead AS (SELECT s.*, row_number() OVER (PARTITION BY question_id ORDER BY score DESC) AS rank FROM scores s JOIN bounds b USING (question_id) WHERE b.block = s.ordinal // {BLOCK_WIDTH} AND place <= 4),
least AS (SELECT question_id, score AS least FROM lead WHERE rank = 10)
SELECT question_id, count(*) AS blocks, count_if(place <= 4 OR least IS NULL OR bound >= least)::BIGINT AS scored FROM bounds LEFT JOIN least USING (question_id) GROUP BY question_id""")
def lexical_search_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of the index hold terms of a question, and how many of them a search had to read."""
    index = retrieval.postings(_passages(spark, sf_dir), BLOCK_WIDTH)
    return retrieval.search(scratch.table(index, "postings"), _questions(spark, sf_dir), 10, width=BLOCK_WIDTH)[1]


@query("""
WITH b AS (SELECT doc_id, doc_id // 50 AS article, doc_id % 50 AS pos, lang AS section, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND quality = 1) AS admitted FROM documents),
n AS (SELECT b.*, p1.doc_id AS p1, CASE WHEN p1.doc_id IS NOT NULL THEN p2.doc_id END AS p2, f1.doc_id AS f1, CASE WHEN f1.doc_id IS NOT NULL THEN f2.doc_id END AS f2 FROM b
  LEFT JOIN b p1 ON p1.article = b.article AND p1.pos = b.pos - 1 AND p1.section = b.section AND p1.admitted LEFT JOIN b p2 ON p2.article = b.article AND p2.pos = b.pos - 2 AND p2.section = b.section AND p2.admitted
  LEFT JOIN b f1 ON f1.article = b.article AND f1.pos = b.pos + 1 AND f1.section = b.section AND f1.admitted LEFT JOIN b f2 ON f2.article = b.article AND f2.pos = b.pos + 2 AND f2.section = b.section AND f2.admitted)
SELECT doc_id, concat_ws(',', p2, p1) AS previous, concat_ws(',', f1, f2) AS following FROM n WHERE admitted""")
def retrieval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents are an article, languages its sections; two admitted passages on either side, none across an excluded one."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    good = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("g")).distinct()
    rows = docs.join(good, F.col("doc_id") == F.col("g"), "left").select(F.floor(F.col("doc_id") / 50).alias("article_id"), (F.col("doc_id") % 50).alias("source_pos"), F.col("lang").alias("section"), F.col("g").isNotNull().alias("admitted"), F.col("doc_id").cast("string").alias("text"))
    hits = rows.where("admitted").select("article_id", "source_pos", F.col("text").cast("long").alias("doc_id"))
    return retrieval.context(hits, rows, 2).select("doc_id", F.array_join("previous", ",").alias("previous"), F.array_join("following", ",").alias("following"))


_SCOPED = """
d AS (SELECT doc_id, source, lang, 'part ' || (n_chars % 3) AS part FROM documents),
s AS (SELECT source, lang, min(doc_id) AS k FROM d GROUP BY ALL),
log AS (
  SELECT min(doc_id) * 10 + 1 AS id, source AS article, '' AS path, NULL::BIGINT AS passage, 'classify' AS action, 'reference or administrative material' AS label, 'r2' AS rubric, NULL::BIGINT AS ended FROM d GROUP BY source
  UNION ALL SELECT k * 10 + 2, source, lang, NULL, 'classify', 'internal lore', CASE WHEN k % 5 = 0 THEN 'r1' ELSE 'r2' END, NULL FROM s
  UNION ALL SELECT k * 10 + 4, source, lang, NULL, 'classify', 'adaptation material', 'r2', CASE WHEN k % 2 = 0 THEN k * 10 + 2 END FROM s WHERE k % 3 = 0
  UNION ALL SELECT min(doc_id) * 10 + 3, source, lang || E'\\n' || part, NULL, 'defer', NULL, 'r2', NULL FROM d GROUP BY source, lang, part HAVING min(doc_id) % 2 = 0
  UNION ALL SELECT l.doc_id * 10 + 5, source, '', l.doc_id, 'classify', CASE WHEN quality = 1 THEN 'internal lore' ELSE 'analysis or reception' END, CASE WHEN l.doc_id % 9 = 0 THEN 'r1' ELSE 'r2' END, NULL FROM labels l JOIN d USING (doc_id)
  UNION ALL SELECT l.doc_id * 10 + 6, source, '', l.doc_id, 'undo', NULL, 'r2', l.doc_id * 10 + 5 FROM labels l JOIN d USING (doc_id) WHERE l.doc_id % 11 = 0),
alive AS (SELECT *, coalesce(label, 'deferred') AS own FROM log WHERE action <> 'undo' AND id NOT IN (SELECT ended FROM log WHERE ended IS NOT NULL)),
held AS (SELECT article, path, passage, max(id) AS decision_id, CASE WHEN min(own) <> max(own) THEN 'ambiguous' WHEN bool_or(rubric <> 'r2') THEN 'stale' WHEN min(own) = 'deferred' THEN 'deferred' ELSE 'classified' END AS state, min(own) AS own FROM alive GROUP BY ALL),
ranked AS (SELECT d.doc_id, h.*, CASE WHEN passage IS NOT NULL THEN 9 WHEN path = '' THEN 0 WHEN path = lang THEN 1 ELSE 2 END AS depth FROM d JOIN held h ON h.article = d.source AND CASE WHEN passage IS NOT NULL THEN passage = d.doc_id ELSE path IN ('', lang, lang || E'\\n' || part) END)
"""


@query("WITH " + _SCOPED + """SELECT doc_id, max(CASE WHEN state = 'classified' THEN own END) AS label, max(state) AS state, max(CASE depth WHEN 9 THEN -1 ELSE depth END)::INT AS depth, max(decision_id) AS decision_id
FROM (SELECT *, max(depth) OVER (PARTITION BY doc_id) AS most FROM ranked) WHERE depth = most GROUP BY doc_id""")
def scoped_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as articles, languages and parts as sections; decisions at every depth, some superseded, undone, stale or at odds."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.concat(F.lit("part "), F.col("n_chars") % 3).alias("part"))
    s = d.groupBy("source", "lang").agg(F.min("doc_id").alias("k"))
    labels = read(spark, sf_dir, "labels").join(d.select("doc_id", "source"), "doc_id")
    null, nobody, words = F.lit(None), F.lit(None).cast("long"), F.lit("classify")

    def event(frame, id_, path, passage, action, label, rubric, ended):
        path = F.array(*path) if path else F.array().cast("array<string>")
        return frame.select(id_.alias("id"), F.col("source").alias("article_id"), path.alias("path"), passage.alias("passage_id"), action.alias("action"), label.cast("string").alias("classification"), rubric.alias("rubric_id"), ended.cast("long").alias("supersedes_event_id"))

    k, now, one = F.col("k"), F.lit("r2"), F.col("doc_id")
    parts = d.groupBy("source", "lang", "part").agg(F.min("doc_id").alias("k")).where("k % 2 = 0")
    log = event(d.groupBy("source").agg(F.min("doc_id").alias("k")), k * 10 + 1, [], nobody, words, F.lit("reference or administrative material"), now, null)
    log = log.unionByName(event(s, k * 10 + 2, ["lang"], nobody, words, F.lit("internal lore"), F.when(k % 5 == 0, "r1").otherwise("r2"), null))
    log = log.unionByName(event(s.where("k % 3 = 0"), k * 10 + 4, ["lang"], nobody, words, F.lit("adaptation material"), now, F.when(k % 2 == 0, k * 10 + 2)))
    log = log.unionByName(event(parts, k * 10 + 3, ["lang", "part"], nobody, F.lit("defer"), null, now, null))
    log = log.unionByName(event(labels, one * 10 + 5, [], one, words, F.when(F.col("quality") == 1, "internal lore").otherwise("analysis or reception"), F.when(one % 9 == 0, "r1").otherwise("r2"), null))
    log = log.unionByName(event(labels.where("doc_id % 11 = 0"), one * 10 + 6, [], one, F.lit("undo"), null, now, one * 10 + 5))
    passages = d.select(F.col("source").alias("article_id"), F.array("lang", "part").alias("heading_path"), F.col("doc_id").alias("passage_id"))
    found = scopes.inherited(passages, log, "r2")
    return found.select(F.col("passage_id").alias("doc_id"), "label", "state", "depth", "decision_id")


@query("""
WITH RECURSIVE p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
q AS (SELECT user_id, event_id, k, (k - 1) // 2 - (event_type = 'error')::INT AS seen FROM p),
s AS (SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS version, NULL::BIGINT AS event_id, false AS won FROM (SELECT DISTINCT user_id FROM q)
  UNION ALL SELECT s.user_id, q.k, CASE WHEN q.seen = s.version THEN s.version + 1 ELSE s.version END, q.event_id, q.seen = s.version FROM s JOIN q ON q.user_id = s.user_id AND q.k = s.k + 1)
SELECT user_id, event_id, version FROM s WHERE won""")
def accepted_activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user is a registry and each event proposes an activation; two see each version, and errors saw an older one."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    seen = F.floor((k - 1) / 2) - (F.col("event_type") == "error").cast("int")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("registry_id"), F.col("event_id").alias("id"), seen.cast("long").alias("seen"))
    return activation.accepted(rows).select(F.col("registry_id").alias("user_id"), F.col("id").alias("event_id"), "version")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type IN ('purchase', 'error')),
s AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::TIMESTAMP AS ts, CAST([] AS VARCHAR[]) AS stack FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT s.user_id, e.k, e.event_id, e.ts, CASE WHEN event_type = 'purchase' THEN list_append(s.stack, 'r' || e.event_id) WHEN len(s.stack) > 0 THEN s.stack[:len(s.stack) - 1] ELSE s.stack END
  FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1),
states AS (SELECT user_id, ts, arg_max(coalesce(stack[-1], ''), event_id) AS release_id FROM s WHERE k > 0 GROUP BY ALL)
SELECT v.event_id, v.user_id, nullif(states.release_id, '') AS release_id FROM (SELECT * FROM events WHERE event_type = 'view') v ASOF LEFT JOIN states ON v.user_id = states.user_id AND v.ts >= states.ts""")
def active_release_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases activate a release in their user's registry, errors roll back; what was active at each view."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("registry_id"), F.col("event_id").alias("id"), F.col("ts").alias("at"), "event_type")
    action = F.when(F.col("event_type") == "error", "rollback").otherwise("activate")
    entries = rows.where("event_type in ('purchase', 'error')").select("registry_id", "id", "at", action.alias("action"), F.concat(F.lit("r"), "id").alias("release_id"))
    found = activation.active_at(entries, rows.where("event_type = 'view'").select("registry_id", "at", "id"))
    return found.select(F.col("id").alias("event_id"), F.col("registry_id").alias("user_id"), "release_id")


KEY = "review round one"
_PAIRS = f"""
pairs AS (SELECT sale_id, max(vendor_id) FILTER (line_no = 1) AS first, max(vendor_id) FILTER (line_no = 2) AS second, max(amount) FILTER (line_no = 1) AS one, max(amount) FILTER (line_no = 2) AS two FROM sale_lines WHERE sale_id IS NOT NULL GROUP BY sale_id),
cases AS (SELECT p.*, s.priority, row_number() OVER (PARTITION BY priority ORDER BY sale_id) - 1 AS ordinal FROM pairs p JOIN (SELECT sale_id, max(priority) AS priority FROM sales GROUP BY sale_id) s USING (sale_id)
  WHERE first <> second AND priority IS NOT NULL),
dealt AS (SELECT *, row_number() OVER (PARTITION BY priority, ordinal // 4 ORDER BY sha256('{KEY}' || E'\\n' || priority || E'\\n' || sale_id), sale_id) > 2 AS turned FROM cases),
sides AS (SELECT sale_id, priority, CASE WHEN turned THEN second ELSE first END AS left_vendor, CASE WHEN turned THEN first ELSE second END AS right_vendor, CASE WHEN turned THEN two ELSE one END AS l, CASE WHEN turned THEN one ELSE two END AS r FROM dealt)
"""


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales are cases, the vendors of their first two lines the conditions, amounts what they deliver; priorities are strata."""
    line = lambda n, c: F.max(F.when(F.col("line_no") == n, F.col(c)))
    pairs = read(spark, sf_dir, "sale_lines").where("sale_id is not null").groupBy(F.col("sale_id").alias("case_id")).agg(line(1, "vendor_id").alias("first"), line(2, "vendor_id").alias("second"), line(1, "amount").alias("one"), line(2, "amount").alias("two"))
    strata = read(spark, sf_dir, "sales").groupBy(F.col("sale_id").alias("case_id")).agg(F.max("priority").alias("stratum"))
    cases = scratch.table(pairs.join(strata, "case_id").where("first <> second and stratum is not null"), "cases")
    cases = integrity.numbered(cases, "stratum", "case_id", F.floor(F.col("case_id") / (1 << 16)), "ordinal")
    return evaluation.sides(cases, KEY)


@query("WITH " + _PAIRS + "SELECT sale_id, priority, left_vendor, right_vendor FROM sides")
def blinded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(spark, sf_dir).select(F.col("case_id").alias("sale_id"), F.col("stratum").alias("priority"), F.col("left").alias("left_vendor"), F.col("right").alias("right_vendor"))


@query("WITH RECURSIVE " + _PAIRS + """, v AS (SELECT *, CASE WHEN l IS NULL OR r IS NULL THEN NULL WHEN l > r THEN 1.0 WHEN l = r THEN 0.5 ELSE 0.0 END AS points FROM sides),
met AS (SELECT a, b, count(*)::DOUBLE AS n, sum(p)::DOUBLE AS points FROM (SELECT left_vendor AS a, right_vendor AS b, points AS p FROM v WHERE points IS NOT NULL UNION ALL SELECT right_vendor, left_vendor, 1 - points FROM v WHERE points IS NOT NULL) GROUP BY ALL),
who AS (SELECT a, row_number() OVER (ORDER BY a) AS i, sum(n) AS n, sum(points) AS points FROM met GROUP BY a),
rival AS (SELECT x.i, list({'j': y.i, 'n': met.n} ORDER BY y.i) AS rivals, any_value(x.points) AS points FROM met JOIN who x USING (a) JOIN who y ON y.a = met.b GROUP BY x.i),
given AS (SELECT list({'i': i, 'rivals': rivals, 'points': points} ORDER BY i) AS everyone FROM rival),
step AS (SELECT 0 AS k, list_transform(everyone, lambda e: 1e0) AS s FROM given
  UNION ALL SELECT k + 1, list_transform(everyone, lambda e: (e.points + 1e0) / (list_sum(list_transform(e.rivals, lambda o: o.n / (s[e.i] + s[o.j]))) + 2e0 / (s[e.i] + 1e0))) FROM step, given WHERE k < 20)
SELECT who.a AS vendor_id, round(s[who.i], 6) AS strength, who.n::BIGINT AS n, who.points FROM who, step WHERE k = 20""")
def pair_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts go by the amounts that the reviewers see left and right; vendors by their strength in 20 rounds."""
    verdict = F.when(F.col("one").isNull() | F.col("two").isNull(), "both fail").when(F.col("one") == F.col("two"), "tie")
    better = F.when((F.col("one") > F.col("two")) == (F.col("left") == F.col("first")), "left better").otherwise("right better")
    reviews = evaluation.unblinded(_sides(spark, sf_dir).withColumn("verdict", F.coalesce(verdict, better)))
    found = evaluation.strengths(evaluation.pair_counts(reviews), rounds=20)
    return found.select(F.col("condition").alias("vendor_id"), F.round("strength", 6).alias("strength"), "n", "points")


@query("""
WITH m AS (SELECT 'docs/' || doc_id AS path, octet_length(encode(text)) AS size, sha256(text) AS sha FROM documents WHERE doc_id % 101 <> 5),
f AS (SELECT 'docs/' || doc_id AS path, octet_length(encode(CASE WHEN doc_id % 97 = 3 THEN text || '!' ELSE text END)) AS size, sha256(CASE WHEN doc_id % 97 = 3 THEN text || '!' ELSE text END) AS sha FROM documents WHERE doc_id % 89 <> 7)
SELECT path, CASE WHEN f.sha IS NULL THEN 'missing' WHEN m.sha IS NULL THEN 'unexpected' ELSE 'changed' END AS state FROM m FULL JOIN f USING (path) WHERE m.sha IS NULL OR f.sha IS NULL OR m.sha <> f.sha OR m.size <> f.size""")
def merkle_inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory of documents against one in which some changed, went and came, by their trees."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    path, folders = F.concat(F.lit("docs/"), "doc_id"), []
    later = F.when(F.col("doc_id") % 97 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    for rows, text in ((docs.where("doc_id % 101 <> 5"), F.col("text")), (docs.where("doc_id % 89 <> 7"), later)):
        folders.append(scratch.new_path(spark, "inventory"))
        merkle.write(integrity.inventory(rows, path, text), folders[-1])
    return merkle.compared(spark, *folders)[0]


@query("""SELECT 'Page ' || page_id AS title, page_id, page_id + 7 AS revision_id, sha256('== Top ==' || E'\\n' || page_id || repeat(' word' || (page_id * 7919 % 1000003), 200)) AS text_sha256 FROM pages WHERE page_id % 10 = 3""")
def dump_index_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as a compressed dump that is indexed in one pass; of the second pass every tenth page is wanted."""
    text = F.concat(F.lit("== Top ==\n"), "page_id", F.repeat(F.concat(F.lit(" word"), F.col("page_id") * 7919 % 1000003), F.lit(200)))
    revision = F.concat(F.lit("<revision><id>"), F.col("page_id") + 7, F.lit("</id><timestamp>2026-06-30T00:00:00Z</timestamp><text>"), text, F.lit("</text></revision>"))
    body = F.concat(F.lit("<page><title>Page "), "page_id", F.lit("</title><ns>0</ns><id>"), "page_id", F.lit("</id>"), revision, F.lit("</page>"))
    path = scratch.new_path(spark, "dump")
    rows = read(spark, sf_dir, "pages").select("page_id", body.alias("value"))
    rows.repartitionByRange(4, "page_id").sortWithinPartitions("page_id").select("value").write.option("compression", "bzip2").text(path)
    files = sorted(spark.read.text(path).inputFiles())  # a dump in several files
    directory = dump_index.write(spark, files, scratch.new_path(spark, "directory"))
    found = dump_index.fetch(directory.where("page_id % 10 = 3"))
    return found.select("title", "page_id", "revision_id", F.sha2(F.encode("raw_wikitext", "UTF-8"), 256).alias("text_sha256"))
