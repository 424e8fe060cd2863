"""DuckDB SQL for the queries of this subpackage that SQL can express over whole tables."""

from __future__ import annotations

OP3_MIX_SOURCES = r"""
WITH d AS (
  SELECT doc_id, source, md5(concat_ws(':', coalesce(doc_id::VARCHAR, 'null'), coalesce(source, 'null'), coalesce(text, 'null'))) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS k FROM s
), c AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS all_size, sum(weight) OVER () AS all_weight,
    coalesce(sum(source_size) OVER below, 0)::DOUBLE AS full_size, coalesce(sum(weight) OVER below, 0.0) AS full_weight
  FROM w WINDOW below AS (ORDER BY source_size / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (all_size * 1.5::DOUBLE - full_size * 2.0::DOUBLE) / (all_weight - full_weight) AS level FROM c
), o AS (
  SELECT arg_min(level, (source_size / weight, k)) AS level FROM l WHERE level * weight <= source_size * 2.0::DOUBLE
), t AS (
  SELECT l.source, l.source_size, least(l.source_size * 2.0::DOUBLE, o.level * l.weight) AS target FROM l, o
), r AS (
  SELECT d.doc_id, d.key, row_number() OVER (PARTITION BY d.key) - 1 AS copy, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT *, (floor(rate) + CASE WHEN ('0x' || substr(md5('17:' || key || ':' || copy), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r
)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM n
"""

OP2_CHAT_EXAMPLES = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length('<s>[INST]</s>') + length(regexp_replace(regexp_replace(role, CTRL, '\1\\\2\3', 'g'), INST, '\1\\\2\3', 'g'))
    + length(regexp_replace(regexp_replace(text, CTRL, '\1\\\2\3', 'g'), INST, '\1\\\2\3', 'g')) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, count(*) OVER (PARTITION BY conv_id) AS turns FROM c
), f AS (
  SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS so_far, role = 'assistant' AS trained FROM e
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (trained), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (trained), '')) AS loss_sha256,
  sum(so_far) FILTER (trained OR n = turns)::BIGINT AS formatted_chars, count(*) FILTER (trained AND text <> '') AS n_examples
FROM f GROUP BY conv_id
""".replace("CTRL", r"'(<)(\\*)(s>|/s>|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)'").replace("INST, ", r"'(\[)(\\*)(INST\]|/INST\])', ")

OP9_THRESHOLD_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 20
"""

OP10_WARC_FIXITY = r"""
WITH p AS (
  SELECT coalesce(floor(page_id / 512.0), -1 - (length(coalesce(url, '')) + length(coalesce(html, ''))) % 4096)::BIGINT AS file, page_id, coalesce(url, '') AS url, html FROM pages
), q AS (
  SELECT file, page_id, url, CASE WHEN page_id % 97 = 5 THEN '#' || substr(html, 2) WHEN page_id % 101 = 7 THEN html || '#' ELSE html END AS html
  FROM p WHERE page_id % 1009 <> 11 OR page_id IS NULL
), sides AS (
  SELECT 1 AS side, * FROM p UNION ALL SELECT 2, * FROM q
), r AS (
  SELECT side, file, page_id, E'WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:' || coalesce(page_id::VARCHAR, '')
    || E'>\r\nWARC-Target-URI: ' || url || E'\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: text/html\r\nContent-Length: '
    || octet_length(encode(coalesce(html, ''))) || E'\r\n\r\n' || coalesce(html, '') || E'\r\n\r\n' AS content
  FROM sides
), d AS (
  SELECT side, file, page_id, octet_length(encode(content))::BIGINT AS size, sha256(content) AS digest FROM r
), o AS (
  SELECT *, row_number() OVER (PARTITION BY side, file, page_id ORDER BY digest)::INTEGER AS copy,
    coalesce(sum(size) OVER (PARTITION BY side, file ORDER BY page_id NULLS FIRST, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d
), a AS (SELECT * FROM o WHERE side = 1), b AS (SELECT * FROM o WHERE side = 2), leaf AS (
  SELECT side, file, start // 65536 AS leaf, string_agg(start || ':' || size || ':' || digest, ';' ORDER BY start, size, digest) AS sums
  FROM o GROUP BY ALL
), bad AS (
  SELECT coalesce(x.file, y.file) AS file, coalesce(x.leaf, y.leaf) AS leaf
  FROM (SELECT * FROM leaf WHERE side = 1) x FULL JOIN (SELECT * FROM leaf WHERE side = 2) y ON x.file = y.file AND x.leaf = y.leaf
  WHERE x.sums IS DISTINCT FROM y.sums
), j AS (
  SELECT coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.copy, b.copy) AS copy,
    coalesce(a.start, b.start) AS start, coalesce(a.size, b.size) AS size, a.digest, b.digest AS replica_digest, a.start AS s1, b.start AS s2
  FROM a FULL JOIN b ON a.file = b.file AND a.page_id IS NOT DISTINCT FROM b.page_id AND a.copy = b.copy
), k AS (
  SELECT *, EXISTS (SELECT 1 FROM bad WHERE bad.file = j.file AND bad.leaf = j.s1 // 65536)
    OR EXISTS (SELECT 1 FROM bad WHERE bad.file = j.file AND bad.leaf = j.s2 // 65536) AS checked FROM j
)
SELECT file, page_id, copy, start, size, digest, replica_digest, start // 65536 AS leaf, checked,
  CASE WHEN NOT checked THEN 'ok' WHEN replica_digest IS NULL THEN 'missing' WHEN digest IS NULL THEN 'extra'
    WHEN digest <> replica_digest THEN 'corrupt' WHEN s1 <> s2 THEN 'moved' ELSE 'ok' END AS status
FROM k
"""

ORACLES = {"op2_chat_examples": OP2_CHAT_EXAMPLES, "op3_mix_sources": OP3_MIX_SOURCES, "op9_threshold_top_k": OP9_THRESHOLD_TOP_K, "op10_warc_fixity": OP10_WARC_FIXITY}
