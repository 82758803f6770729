"""DuckDB SQL for the results of the queries that SQL can express; each runs over the whole tables."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

#: (doc_id, n_shingles, component_id): all pairs that share a shingle, then reachability.
NGRAM_JOIN = rf"""
WITH RECURSIVE
texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
words AS (SELECT doc_id, regexp_extract_all(t, '{_WORD}') AS w FROM texts),
sets AS (
  SELECT doc_id, unnest(list_distinct(CASE
    WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS shingle
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least ON least.a = d.doc_id
"""

#: (page_id, payload_bytes, payload_digest, record_type, refers_to)
WARC = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
latest AS (SELECT *, n >= 1000 AND page_id <> max(page_id) OVER (PARTITION BY digest) AS again, max(page_id) OVER (PARTITION BY digest) AS first FROM payloads)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM latest
"""

#: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared): every window of 400 bytes, and of 256, by MD5.
BYTES = """
WITH texts AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS t, strlen(coalesce(text, '')) AS n FROM documents),
places AS (SELECT doc_id, t, n, unnest(range(1, n + 1)) AS i FROM texts),
windows AS (SELECT doc_id, i, CASE WHEN i <= n - 399 THEN md5(t[i : i + 399]) END AS long_md5, CASE WHEN i <= n - 255 THEN md5(t[i : i + 255]) END AS short_md5 FROM places),
repeated AS (
  SELECT doc_id, i, long_md5 IS NOT NULL AND count(*) OVER (PARTITION BY long_md5) > 1 AS again, short_md5 IS NOT NULL AND count(*) OVER (PARTITION BY short_md5) > 1 AS near
  FROM windows),
covered AS (
  SELECT doc_id, i, coalesce(max(CASE WHEN again THEN i END) OVER w >= i - 399, false) AS gone, coalesce(max(CASE WHEN near THEN i END) OVER w >= i - 255, false) AS shared
  FROM repeated WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
edges AS (SELECT *, gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY doc_id ORDER BY i) AS fresh FROM covered),
numbered AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM edges),
runs AS (SELECT doc_id, run, gone, min(i) AS low, max(i) AS high, sum(shared::INT) AS shared FROM numbered GROUP BY ALL),
sums AS (
  SELECT r.doc_id, sum(CASE WHEN gone THEN high - low + 1 ELSE 0 END)::BIGINT AS n_removed, count(*) FILTER (gone) AS n_spans, sum(shared)::BIGINT AS n_shared,
    string_agg(hex(t[low : high]), '' ORDER BY low) FILTER (NOT gone) AS kept
  FROM runs r JOIN texts USING (doc_id) GROUP BY r.doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(n_shared, 0) AS n_shared
FROM texts LEFT JOIN sums USING (doc_id)
"""

#: (doc_id, n_words, n_removed, n_spans, kept_sha256): every window of 35 words, by MD5.
PASSAGES = rf"""
WITH texts AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts),
windows AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i <= len(w) - 34 THEN md5(array_to_string(w[i : i + 34], ' ')) END AS window_md5 FROM places),
repeated AS (SELECT doc_id, i, word, window_md5 IS NOT NULL AND count(*) OVER (PARTITION BY window_md5) > 1 AS again FROM windows),
covered AS (SELECT doc_id, i, word, coalesce(max(CASE WHEN again THEN i END) OVER (PARTITION BY doc_id ORDER BY i) >= i - 34, false) AS gone FROM repeated),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM covered),
sums AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM edges GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN sums USING (doc_id)
"""

_ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = (("assign", _ASSIGN, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
_parts = " UNION ALL ".join(
    f"""SELECT doc_id, {k} AS kind, '{name}' AS name, {least} AS least, unnest(string_split_regex(t, '{pattern}')) AS gap,
    unnest(regexp_extract_all(t, '{pattern}')) AS hit, unnest(regexp_extract_all(t, '{pattern}', {group})) AS val, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS k FROM texts"""
    for k, (name, pattern, group, least) in enumerate(_KINDS)
)
#: (doc_id, n_assign, n_access, n_hex, base_sha256, spans): where a match starts follows from the lengths of what lies before it.
SECRETS = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
parts AS ({_parts}),
ends AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, kind ORDER BY k)::BIGINT AS stop FROM parts),
found AS (SELECT doc_id, kind, name, stop - length(hit) AS start, stop FROM ends WHERE length(val) >= least),
sums AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans
  FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN sums USING (doc_id)
"""

#: (vec_id, n_links, component_id, kept): all pairs of one label.
VECTORS = """
WITH RECURSIVE
doubles AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
sound AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM doubles
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v JOIN least ON least.a = v.vec_id LEFT JOIN counts ON counts.a = v.vec_id
"""

#: (doc_id, source, mix_block, mix_slot, mix_release, mix_deadline, mix_offset, mix_phase): a step of recursion for each slot.
MIXING = """
WITH RECURSIVE
docs AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS k, greatest(length(coalesce(text, '')), 1)::BIGINT AS chars,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (SELECT k, sum(chars)::BIGINT AS chars FROM docs GROUP BY k),
size AS (SELECT greatest(65536, (sum(chars)::BIGINT + 262143) // 262144) AS block FROM sums),
parts AS (
  SELECT k, (chars + block - 1) // block AS blocks, greatest(1, round(sqrt(chars::DOUBLE) / sum(sqrt(chars::DOUBLE)) OVER () * 1099511627776.0))::BIGINT AS part
  FROM sums, size),
plan AS (SELECT list(k ORDER BY k) AS ks, list(part ORDER BY k) AS p, list(blocks ORDER BY k) AS blocks, sum(part)::BIGINT AS whole, sum(blocks)::BIGINT AS slots FROM parts),
edf AS (
  SELECT 0::BIGINT AS slot, list_transform(p, lambda x: 0::BIGINT) AS done, blocks AS rest, 0::BIGINT AS base, whole AS total, 0 AS phase,
    0::BIGINT AS i, 0::BIGINT AS release, 0::BIGINT AS deadline, 0 AS own_phase
  FROM plan
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(p) + 1), lambda j: CASE WHEN rest[pick] = 1 THEN 0 WHEN j = pick THEN done[j] + 1 ELSE done[j] END),
    list_transform(range(1, len(p) + 1), lambda j: CASE WHEN j = pick THEN rest[j] - 1 ELSE rest[j] END),
    CASE WHEN rest[pick] = 1 THEN slot + 1 ELSE base END, CASE WHEN rest[pick] = 1 THEN total - p[pick] ELSE total END, phase + (rest[pick] = 1)::INT,
    pick, base + (done[pick] * total) // p[pick], code // 65536, phase
  FROM (
    SELECT *, code % 65536 AS pick
    FROM (
      SELECT edf.*, p, list_min(list_transform(range(1, len(p) + 1), lambda j: CASE
        WHEN rest[j] > 0 AND (done[j] * total) // p[j] <= slot - base THEN (base + ((done[j] + 1) * total + p[j] - 1) // p[j]) * 65536 + j END)) AS code
      FROM edf, plan WHERE slot < slots) tried) picked),
slots AS (SELECT ks[i] AS k, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS b, slot - 1 AS slot, release, deadline, own_phase FROM edf, plan WHERE i > 0),
placed AS (SELECT *, coalesce(sum(chars) OVER (PARTITION BY k ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM docs)
SELECT doc_id, source, before // block AS mix_block, slot AS mix_slot, release AS mix_release, deadline AS mix_deadline, before % block AS mix_offset, own_phase AS mix_phase
FROM placed CROSS JOIN size JOIN slots ON slots.k = placed.k AND slots.b = before // block
"""

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": NGRAM_JOIN,
    "op3_warc_packages": WARC,
    "op4_suffix_array_dedup": BYTES,
    "op5_secret_ledger": SECRETS,
    "op6_multi_index": VECTORS,
    "op7_pfair_mixing": MIXING,
    "op10_substring_dedup": PASSAGES,
}
