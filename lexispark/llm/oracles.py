"""DuckDB SQL for the training-data queries that SQL can express; tests compare the others with brute force."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"

RULES = rf"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8
), r AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i : i + 7], ' ')) AS n FROM g
), c AS (
  SELECT doc_id, sum(k) AS n_repeat_words FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS k FROM r WHERE n > 1) GROUP BY 1
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM d LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (word_chars < 2 * n_words)::INT + 8 * (word_chars > 15 * n_words)::INT
    + 16 * (10 * n_symbols > n_words)::INT + 32 * (10 * n_dup_lines > 3 * n_lines)::INT + 64 * (2 * n_upper > word_chars)::INT AS BIGINT) AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"""

URLS = r"""WITH rules(v, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), f AS (
  SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS n
  FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE n = 1"""

COMPONENTS = rf"""WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)
), reach(a, b) AS (
  SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), least AS (
  SELECT a, min(b) AS b FROM reach GROUP BY 1
), l AS (
  SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, b), doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least ON doc_id = a
)
SELECT doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id FROM l"""

NEGATIVES = """WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c AS (
  SELECT id, label, unnest(q) AS x, unnest(range(len(q))) AS i FROM v
), s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS s FROM c a JOIN c b USING (i) WHERE a.id % 100 = 0 AND a.id <> b.id GROUP BY ALL
), p AS (
  SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
), n AS (
  SELECT p.a, p.p, p.ps, s.b, s.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY s.s DESC, s.b) AS k FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.ps <= 100 * s.s AND s.s <= p.ps
)
SELECT a AS anchor_id, p AS positive_id, CAST(k AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE k <= 5"""

ORACLES = {"op6_quality_rules": RULES, "op8_jaccard_join": COMPONENTS, "op10_url_filter": URLS, "op12_hard_negatives": NEGATIVES}
