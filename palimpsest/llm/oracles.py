"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .secrets import RULES

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '{WORD}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format('text')}, '{WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT n FROM p),
h AS (SELECT x.doc_id, x.i, x.n, p.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, l WHERE len(w) >= n)) x JOIN p ON x.n = p.n AND x.k = p.k),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

SHINGLE = r"[^\x20\x09-\x0D]+"
NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '{SHINGLE}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
g AS (SELECT e.a, e.b FROM e JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _rule(rank: int, rule) -> str:
    regex = rule.regex.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, regexp_extract_all(t, '{regex}') AS found, regexp_extract_all(t, '{regex}', {rule.value}) AS vals, string_split_regex(t, '{regex}') AS gaps FROM d"""


SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({' UNION ALL '.join(_rule(i, r) for i, r in enumerate(RULES))}),
u AS (SELECT doc_id, rank, kind, least, unnest(found) AS f, unnest(vals) AS v, unnest(gaps[1:len(found)]) AS g, generate_subscripts(found, 1) AS i FROM m WHERE len(found) > 0),
p AS (SELECT *, sum(length(g)) OVER w + sum(length(f)) OVER w - length(f) AS a FROM u WINDOW w AS (PARTITION BY doc_id, rank ORDER BY i)),
s AS (SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + length(f) AS BIGINT) AS span FROM p WHERE length(v) >= least),
c AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(span, ',' ORDER BY a, rank) FILTER (WHERE rank < 3) AS base, string_agg(span, ',' ORDER BY a, rank) AS spans FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c USING (doc_id)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LEXICAL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format('text')}, '{TERM}') AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, t FROM d WHERE len(t) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM c),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER.format('text')}, '{TERM}')) AS term FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

ORACLES = {"op1_decontamination": DECONTAMINATION, "op2_near_duplicates": NEAR_DUPLICATES, "op4_secrets": SECRETS, "op11_hard_negatives": HARD_NEGATIVES, "op12_lexical": LEXICAL}
