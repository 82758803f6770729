"""Queries on titles, candidates, blocks, passages and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import curation, extract, integrity, release, resolve

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pseudo_wikitext(html):
    """Web pages as wiki text, an adapter of these queries: headings, list items and paragraphs; a footer is references."""
    for pattern, new in (("(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>|<!--.*?-->", ""), ("<h1[^>]*>", "\n\n== "), ("</h1>", " ==\n\n"), ("<footer[^>]*>", "\n\n== References ==\n\n"), ("<li[^>]*>", "\n* "), ("</?(p|br|ul|div|article|nav|body|head|html)[^>]*>", "\n\n"), ("<[^>]*>", "")):
        html = F.regexp_replace(html, pattern, new)
    return html


_WIKI = """
wiki AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?s)<(script|style|title)[^>]*>.*?</(script|style|title)>|<!--.*?-->', '', 'g'), '<h1[^>]*>', E'\\n\\n== ', 'g'), '</h1>', E' ==\\n\\n', 'g'),
  '<footer[^>]*>', E'\\n\\n== References ==\\n\\n', 'g'), '<li[^>]*>', E'\\n* ', 'g'), '</?(p|br|ul|div|article|nav|body|head|html)[^>]*>', E'\\n\\n', 'g'), '<[^>]*>', '', 'g') AS raw FROM pages),
lines AS (SELECT page_id, unnest(string_split(raw, E'\\n')) AS line, generate_subscripts(string_split(raw, E'\\n'), 1) AS pos FROM wiki),
marked AS (SELECT *, regexp_matches(line, '^==[^=].*==\\s*$') AS head, trim(line) = '' AS blank FROM lines),
numbered AS (SELECT *, sum((head OR blank)::INT) OVER (PARTITION BY page_id ORDER BY pos) AS block_no, sum(head::INT) OVER (PARTITION BY page_id ORDER BY pos) AS section FROM marked),
titles AS (SELECT page_id, section, regexp_extract(line, '^==\\s*(.*?)\\s*==\\s*$', 1) AS title FROM numbered WHERE head),
blocks AS (SELECT page_id, block_no, section, trim(string_agg(line, E'\\n' ORDER BY pos), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS block FROM numbered WHERE NOT (head OR blank) GROUP BY ALL),
placed AS (SELECT b.*, coalesce(t.title, 'Lead') AS heading FROM blocks b LEFT JOIN titles t USING (page_id, section))
"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", pseudo_wikitext(F.col("html")).alias("raw"))
    return extract.placed_blocks(pages, "page_id", "raw")


@query("SELECT page_id, trim(replace(regexp_extract(url, '([^/]+)$', 1), '_', ' ')) AS title, upper(left(trim(replace(regexp_extract(url, '([^/]+)$', 1), '_', ' ')), 1)) || substr(trim(replace(regexp_extract(url, '([^/]+)$', 1), '_', ' ')), 2) AS title_key FROM pages")
def title_key_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.regexp_extract("url", "([^/]+)$", 1)
    return read(spark, sf_dir, "pages").select("page_id", T.normalized_title(slug).alias("title"), T.title_key(slug).alias("title_key"))


@query("""
WITH RECURSIVE cats AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS a FROM (SELECT DISTINCT source FROM documents)),
pages AS (SELECT 0 AS phase, a, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS b, source, doc_id AS page_id, trim(replace(split_part(text, E'\\n', 1), '_', ' ')) AS title FROM documents JOIN cats USING (source)),
named AS (SELECT 1, 0, unnest(range(3)), NULL, NULL, unnest(['Of', 'of', 'The'])),
listed AS (SELECT *, replace(lower(title), 'ß', 'ss') AS folded, row_number() OVER (ORDER BY phase, a, b) AS k FROM (SELECT * FROM pages WHERE b <= 100 UNION ALL SELECT * FROM named)),
fold AS (SELECT 0::BIGINT AS k, -1::BIGINT AS cat, 0 AS had, CAST([] AS BIGINT[]) AS ids, CAST([] AS VARCHAR[]) AS titles, 0 AS n, false AS new
  UNION ALL SELECT x.k, CASE WHEN phase = 0 THEN a ELSE cat END, x.first_had, CASE WHEN good AND page_id IS NOT NULL THEN list_append(ids, page_id) ELSE ids END, CASE WHEN good THEN list_append(titles, folded) ELSE titles END, n + good::INT, good
  FROM (SELECT listed.*, cat, ids, titles, n, CASE WHEN phase = 0 AND a <> cat THEN n ELSE had END AS first_had,
      n < 100 AND (phase = 1 OR b <= 100 - CASE WHEN phase = 0 AND a <> cat THEN n ELSE had END) AND NOT list_contains(titles, folded) AND NOT coalesce(list_contains(ids, page_id), false) AS good
    FROM fold JOIN listed ON listed.k = fold.k + 1) x)
SELECT fold.n - 1 AS ord, CASE phase WHEN 0 THEN 'category or API' ELSE 'human nomination' END AS discovery_route,
  CASE phase WHEN 0 THEN 'https://en.wikipedia.org/wiki/Category:' || source ELSE 'operator nomination' END AS discovery_reference, title AS observed_page_title, page_id AS observed_page_id
FROM fold JOIN listed USING (k) WHERE new""")
def greedy_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are categories in order, documents their pages, first lines the titles."""
    docs = read(spark, sf_dir, "documents")
    names = docs.select("source").distinct()
    order = names.withColumn("category_ord", F.row_number().over(Window.orderBy("source")) - 1)  # a row for each source
    pages = docs.join(F.broadcast(order), "source").select(F.col("source").alias("category"), "category_ord", F.col("doc_id").alias("page_ord"), F.col("doc_id").alias("page_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    named = spark.createDataFrame(list(enumerate(["Of", "of", "The"])), "nomination_ord int, title string")
    return resolve.discover(pages, named, 100)


@query("""
WITH RECURSIVE edges AS (SELECT doc_id AS a, CASE WHEN doc_id % 50 = 7 THEN doc_id + 1 WHEN doc_id % 50 = 8 THEN doc_id - 1 ELSE doc_id // 2 END AS b FROM documents WHERE doc_id % 10 <> 0),
walk AS (SELECT doc_id AS origin, doc_id AS here, [doc_id] AS path, false AS loop FROM documents
  UNION ALL SELECT origin, b, list_append(path, b), list_contains(path, b) FROM walk JOIN edges ON here = a WHERE NOT loop)
SELECT origin AS start_key, arg_max(here, len(path)) AS target_key, max(len(path)) - 1 AS hops, bool_or(loop) AS loop FROM walk GROUP BY origin""")
def redirect_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    to = F.when(F.col("doc_id") % 50 == 7, F.col("doc_id") + 1).when(F.col("doc_id") % 50 == 8, F.col("doc_id") - 1).otherwise(F.floor(F.col("doc_id") / 2))
    edges = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("source_key"), to.alias("target_key"))
    return resolve.resolved(docs.select(F.col("doc_id").alias("start_key")), edges).select("start_key", "target_key", F.col("hops").cast("long").alias("hops"), "loop")


@query("""
WITH c AS (SELECT doc_id AS ord, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS pid, 'P' || (doc_id // 2)::VARCHAR AS key FROM documents),
p AS (SELECT page_id, 'P' || page_id::VARCHAR AS key, (page_id % 7 = 0)::INT AS ns FROM pages),
m AS (SELECT c.*, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.ns, b.ns) AS ns FROM c LEFT JOIN p a ON c.pid = a.page_id LEFT JOIN p b ON c.key = b.key),
w AS (SELECT ord, CASE WHEN page_id IS NULL THEN 0 WHEN page_id % 11 = 0 THEN 1 WHEN page_id % 13 = 0 THEN 2 WHEN ns <> 0 THEN 3 END AS why, page_id, ns FROM m)
SELECT ord, CASE why WHEN 0 THEN 'source scan' ELSE 'redirect resolution' END AS stage,
  CASE why WHEN 0 THEN 'candidate absent from source snapshot' WHEN 1 THEN 'redirect loop at P' || page_id WHEN 2 THEN 'redirect target absent from source snapshot' ELSE 'namespace ' || ns || ' is outside namespace 0' END AS reason,
  why IN (0, 2) AS recoverable FROM w WHERE why IS NOT NULL""")
def candidate_match_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    candidates = docs.select(F.col("doc_id").alias("ord"), F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).alias("observed_page_id"), F.concat(F.lit("P"), F.floor(F.col("doc_id") / 2)).alias("title_key"))
    pages = pages.select("page_id", F.concat(F.lit("P"), "page_id").alias("title_key"), (F.col("page_id") % 7 == 0).cast("int").alias("namespace"), F.col("page_id").alias("scan_pos"))
    rows = resolve.matched(candidates, pages)
    page = F.col("page.page_id")
    why = resolve.failure(page, F.when(page % 11 == 0, F.col("page.page_key")), F.when(page % 13 != 0, page), F.col("page.namespace"))
    return rows.select("ord", why.alias("why")).where("why is not null").select("ord", "why.*")


@query("SELECT doc_id // 7 AS target, max(doc_id) AS candidate, arg_max(source, doc_id) AS source, min(doc_id) AS first_order FROM documents GROUP BY 1")
def target_collapse_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 7).alias("target"), F.col("doc_id").alias("candidate"), "source")
    return resolve.collapsed_targets(rows, "target", "candidate")


@query("WITH " + _WIKI + "SELECT page_id, block_no, sha256(block) AS block_sha256, row_number() OVER (PARTITION BY page_id, heading ORDER BY block_no) AS paragraph_ordinal FROM placed")
def block_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = extract.ordinals(_placed(spark, sf_dir), "page_id", "path", "block_no")
    return rows.select("page_id", "block_no", F.sha2(F.encode("block", "UTF-8"), 256).alias("block_sha256"), "paragraph_ordinal")


@query("WITH " + _WIKI + "SELECT page_id, block_no, heading AS heading_path FROM placed")
def heading_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("page_id", "block_no", F.array_join("path", " > ").alias("heading_path"))


@query("WITH " + _WIKI + """SELECT CASE WHEN lower(heading) IN ('bibliography', 'external links', 'further reading', 'notes', 'references', 'sources') THEN 'reference or administrative material'
  WHEN regexp_matches(block, '(^|\\n)\\s*[*#;:]') THEN 'list' WHEN contains(block, '{|') OR contains(block, '|}') THEN 'table' WHEN regexp_matches(lower(block), '<poem|<blockquote') THEN 'block quotation'
  WHEN regexp_matches(block, '(?s)\\{\\{.*?\\}\\}') THEN 'unresolved template' ELSE 'prose' END AS class, count(*) AS n, sum(length(block)) AS chars FROM placed GROUP BY 1""")
def block_classification_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _placed(spark, sf_dir).select(extract.block_class(F.col("path"), F.col("block")).alias("class"), "block")
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.sum(F.length("block")).alias("chars"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) AS text_sha256 FROM documents")
def whitespace_normalize_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode(T.collapsed(F.col("text")), "UTF-8"), 256).alias("text_sha256"))


@query("""SELECT conv_id, turn, 'passage_' || sha256('["conv' || conv_id || '",["' || role || '"],' || turn || ']') AS passage_id FROM conversations""")
def passage_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = extract.passage_ids(F.concat(F.lit("conv"), "conv_id"), F.array("role"), F.col("turn"))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("passage_id"))


@query("SELECT doc_id, length(text) AS n, CASE WHEN length(text) <= 26 THEN text ELSE rtrim(left(text, 10), E' \\n\\t') || '... [truncated]' END AS at_40, CASE WHEN length(text) <= 66 THEN text ELSE rtrim(left(text, 50), E' \\n\\t') || '... [truncated]' END AS at_80, CASE WHEN length(text) <= 160 THEN text ELSE rtrim(left(text, 144), E' \\n\\t') || '... [truncated]' END AS at_200 FROM documents")
def snippet_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.length(text).alias("n"), *[T.snippet(text, w).alias(f"at_{w}") for w in (40, 80, 200)])


@query("""SELECT conv_id, turn, '{"conv_id":' || conv_id || ',"next_role":' || coalesce('"' || lead(role) OVER w || '"', 'null') || ',"previous_role":' || coalesce('"' || lag(role) OVER w || '"', 'null') || ',"role":"' || role || '","turn":' || turn || '}' AS evidence FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def evidence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    fields = {"role": F.col("role"), "turn": F.col("turn"), "conv_id": F.col("conv_id"), "previous_role": F.lag("role").over(w), "next_role": F.lead("role").over(w)}
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", *[v.alias(f"f_{k}") for k, v in fields.items()]).select("conv_id", "turn", curation.evidence(**{k: F.col(f"f_{k}") for k in fields}).alias("evidence"))


@query("""WITH d AS (SELECT doc_id, max(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS lore FROM labels GROUP BY 1)
SELECT source, count(*) AS n_lore, sha256(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id)) AS lore_ids_sha256, min(doc_id) AS first_id FROM documents JOIN d USING (doc_id) WHERE lore = 1 GROUP BY source""")
def lore_release_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as articles, labels as decisions (without one a document is reference material): the lore a release of them has."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    lore = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("lore"))
    label = F.when(F.col("lore"), release.LORE).otherwise("reference or administrative material")
    events = docs.join(lore, "doc_id", "left").select(F.col("doc_id").alias("id"), F.lit("classify").alias("action"), F.col("doc_id").alias("passage_id"), label.alias("classification"), F.lit(None).cast("long").alias("supersedes_event_id"))
    passages = docs.select(F.col("source").alias("article_artifact_id"), F.col("doc_id").alias("passage_id"), F.col("doc_id").alias("source_pos"))
    ids = F.col("lore_passage_ids")
    found = release.selection(passages, events)
    return found.select(F.col("article_artifact_id").alias("source"), F.size(ids).cast("long").alias("n_lore"), F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("lore_ids_sha256"), ids[0].alias("first_id"))


@query("SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.repeated(read(spark, sf_dir, "documents").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256")), "sha256")


@query("SELECT 'data/articles/' || doc_id || '.json' AS path, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents")
def digest_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.inventory(read(spark, sf_dir, "documents"), F.concat(F.lit("data/articles/"), "doc_id", F.lit(".json")), F.col("text"))


@query("""WITH m AS (SELECT 'p' || doc_id AS path, sha256(text) AS s FROM documents WHERE doc_id % 5 <> 0), f AS (SELECT 'p' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS s FROM documents WHERE doc_id % 3 <> 0)
SELECT path, CASE WHEN f.s IS NULL THEN 'missing' WHEN m.s IS NULL THEN 'unexpected' ELSE 'changed' END AS state FROM m FULL JOIN f USING (path) WHERE m.s IS DISTINCT FROM f.s""")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("p"), "doc_id")
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return integrity.compared(integrity.inventory(docs.where("doc_id % 5 <> 0"), path, F.col("text")), integrity.inventory(docs.where("doc_id % 3 <> 0"), path, changed))


@query("SELECT 'left only' AS side, doc_id FROM documents ANTI JOIN (SELECT DISTINCT doc_id + 3 AS doc_id FROM labels) l USING (doc_id) UNION ALL SELECT 'right only', doc_id FROM (SELECT DISTINCT doc_id + 3 AS doc_id FROM labels) l ANTI JOIN documents USING (doc_id)")
def fk_two_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.both_ways(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select((F.col("doc_id") + 3).alias("doc_id")), "doc_id")


@query("SELECT lang, count(DISTINCT source) AS variants FROM documents GROUP BY lang")
def source_constancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.constant(read(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT count(*) AS n, count_if(regexp_matches(split_part(split_part(url, '//', 2), '/', 1), '^[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?$')) AS release_ids, count_if(regexp_matches(split_part(split_part(url, '//', 2), '/', 1), '^[a-z0-9][a-z0-9._-]{0,63}$') AND NOT contains(split_part(split_part(url, '//', 2), '/', 1), '..')) AS labels FROM pages")
def label_regex_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))
    return read(spark, sf_dir, "pages").agg(F.count("*").alias("n"), F.count_if(integrity.release_id(host)).alias("release_ids"), F.count_if(integrity.backup_label(host)).alias("labels"))
