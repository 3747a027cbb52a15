"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, {SPACED}) AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
t AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON r.x = s.doc_id GROUP BY s.doc_id, sh
"""

SUBSTRING = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i+19], ' ') AS key FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
d AS (SELECT doc_id, i FROM p QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, i) > 1),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM d, unnest(range(20)) AS t(k)),
x AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT x.doc_id, count(g.i)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS kept FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY x.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""

CONTAMINATION = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWER}, {ALNUM}) AS ws FROM documents), b AS (SELECT item_id, regexp_extract_all({LOWER}, {ALNUM}) AS ws FROM benchmark),
q AS (SELECT DISTINCT item_id, least(13, len(ws)) AS m, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS key FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT DISTINCT m FROM q),
p AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS key FROM w, n, unnest(range(1, len(ws) - m + 2)) AS t(i)),
h AS (SELECT doc_id, item_id, i, p.m FROM p JOIN q ON p.key = q.key AND p.m = q.m),
c AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_hit FROM h, unnest(range(m)) AS t(k) GROUP BY doc_id),
l AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated FROM w LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)
"""

SQL = {"op1_ngram_jaccard_join": JACCARD, "op6_substring_dedup": SUBSTRING, "op9_decontamination": CONTAMINATION}
