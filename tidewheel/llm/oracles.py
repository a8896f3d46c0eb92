"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .rules import STOP_WORDS

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP4 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s FROM w),
n AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS g FROM s),
few AS (SELECT g FROM e GROUP BY g HAVING count(*) > 1),
f AS (SELECT e.* FROM e SEMI JOIN few USING (g)),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM f a JOIN f b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
good AS (
  SELECT x, y FROM link JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
walk(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT walk.doc_id, y FROM walk JOIN good ON x = other)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n
JOIN (SELECT doc_id, min(other) AS component_id FROM walk GROUP BY 1) c USING (doc_id)
"""

OP6 = rf"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
dw AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
    SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
hit AS (SELECT DISTINCT r, dw.k, i, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN item USING (r)
"""

_STOP = "[" + ", ".join(f"'{x}'" for x in STOP_WORDS) + "]"

OP8 = rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS l FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT r, g FROM g GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM g SEMI JOIN twice USING (r, g)) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(translate(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ', '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) - length(regexp_replace(t, '[a-z]', '', 'g')) AS low,
    len(list_filter(w, lambda x: x = '|')) AS pipes,
    len(list_intersect(list_distinct(list_transform(w, lambda x: lower(x))), {_STOP})) AS stops
  FROM w LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
    AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 25.0
    AND n_symbols / greatest(word_chars, 1) <= 0.30
    AND n_dup_lines / greatest(n_lines, 1) <= 0.60
    AND pipes / greatest(n_words, 1) <= 0.20
    AND up / greatest(up + low, 1) <= 0.80
    AND stops >= 1 AS kept
FROM m
"""

ORACLES = {"op4_ngram_jaccard_join": OP4, "op6_decontamination": OP6, "op8_quality_rules": OP8}
