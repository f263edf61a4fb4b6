"""The contracts of some operators in DuckDB, by brute force: every pair, every window."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Smallest node that reaches each node by links l(a, b) of both directions: it is less than every node of its paths.
_LOW = "r AS (SELECT a AS node, a AS low FROM l UNION SELECT l.b, r.low FROM r JOIN l ON r.node = l.a AND r.low < l.b), c AS (SELECT node, min(low) AS low FROM r GROUP BY 1)"

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  ok AS (SELECT * FROM v WHERE len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
  n AS (SELECT a AS node, count(*)::BIGINT AS n FROM l GROUP BY 1), {_LOW}
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.low, vec_id) AS component_id, coalesce(c.low, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.node = vec_id LEFT JOIN c ON c.node = vec_id"""

MINHASH_DEDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i + 3], ' ') FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
  n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  k AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.n >= 80 * (x.n + y.n - p.n)),
  l AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), {_LOW}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM again),
  word AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM w),
  kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS kept, count(gone.i)::BIGINT AS n_removed FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def _round(n: int) -> str:
    """Round n of the codebooks: the entries of n - 1, and the means of the parts that each is nearest to."""
    return f"""a{n} AS ({_nearest(n - 1)}),
  s{n} AS (SELECT p, e, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT p, e, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM a{n}) GROUP BY 1, 2, 3),
  m{n} AS (SELECT p, e, list((s - (((s % n) + n) % n)) // n ORDER BY d) AS c FROM s{n} GROUP BY 1, 2),
  b{n} AS (SELECT b.p, b.e, coalesce(m{n}.c, b.c) AS c FROM b{n - 1} b LEFT JOIN m{n} ON m{n}.p = b.p AND m{n}.e = b.e)"""


def _nearest(n: int) -> str:
    away = "list_sum([(x.v[i] - b.c[i]) * (x.v[i] - b.c[i]) FOR i IN range(1, len(x.v) + 1)])::BIGINT"
    return f"SELECT vec_id, label, p, v, e.e, e.away FROM (SELECT x.vec_id, x.label, x.p, x.v, min({{'away': {away}, 'e': b.e}}) AS e FROM x JOIN b{n} b ON b.p = x.p GROUP BY ALL)"


VECTOR_CODES = f"""
WITH k AS (SELECT vec_id, label, [floor(256 * y::DOUBLE)::BIGINT FOR y IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
  x AS (SELECT vec_id, label, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS v FROM (SELECT *, unnest(range(16)) AS p FROM k)),
  b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM x QUALIFY e < 64),
  {_round(1)}, {_round(2)}, f AS ({_nearest(2)}),
  h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2),
  r AS (SELECT vec_id, label, lower(string_agg(printf('%02x', e), '' ORDER BY p)) AS code, sum(away)::BIGINT AS error FROM f GROUP BY 1, 2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r, h"""

HARD_NEGATIVES = """
WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * y::DOUBLE) FOR y IN embedding] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
  s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b)::INTEGER AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s QUALIFY rank <= 10"""

_LETTERS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_LETTERS}) AS w FROM documents),
  b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_LETTERS}) AS w FROM benchmark),
  s AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT *, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
  g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT d.*, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM s) ON len(w) >= n)),
  h AS (SELECT g.doc_id, g.n, g.i, s.item_id FROM g JOIN s USING (n, s)),
  c AS (SELECT doc_id, count(DISTINCT i)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM h) GROUP BY 1),
  m AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)"""

SUFFIX_DEDUP = """
WITH n AS (SELECT doc_id, h, len(h) // 2 AS n FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
  g AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(1, n - 98)) AS i FROM n WHERE n >= 100)),
  again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
  r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again),
  s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
  p AS (SELECT doc_id, a, e, lag(e, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM s),
  k AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS e, string_agg(substr(h, 2 * b - 1, 2 * (a - b)), '' ORDER BY a) AS kept FROM p JOIN n USING (doc_id) GROUP BY doc_id)
SELECT n.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(e, 1) - 1))) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)"""
