"""SQL forms of the registered queries, for DuckDB on the same tables, where there is one.

Op1, op4 to op8, op10 and op13 have none for all of their columns (labels of the method,
tokenizers, archives, trained scores, eigenvectors) and are tested against brute force.  Op3,
op9 and op12 compare all pairs, which is fit for small tables only."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+')"

OP2 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n1 AS (SELECT a, count(*) AS n FROM p GROUP BY ALL), n2 AS (SELECT b, a, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY ALL), n3 AS (SELECT c, b, a, count(*) AS n FROM p WHERE c IS NOT NULL GROUP BY ALL),
s AS (SELECT r, sum(CASE WHEN p.c IS NOT NULL THEN ln(n3.n) - ln(h2.n) WHEN p.b IS NOT NULL THEN ln(n2.n) - ln(h1.n) ELSE ln(n1.n) - ln((SELECT count(*) FROM p)) END) AS s
  FROM p JOIN n1 ON n1.a = p.a LEFT JOIN n1 h1 ON h1.a = p.b LEFT JOIN n2 ON n2.b = p.b AND n2.a = p.a LEFT JOIN n2 h2 ON h2.b = p.c AND h2.a = p.b LEFT JOIN n3 ON n3.c = p.c AND n3.b = p.b AND n3.a = p.a GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s.s, 0.0), 4) AS log_score, round(CASE WHEN len(w) > 0 THEN s.s / len(w) END, 4) AS mean_log_score,
  CAST(least(len(w), 1) AS BIGINT) AS n_order1, CAST(CASE WHEN len(w) > 1 THEN 1 ELSE 0 END AS BIGINT) AS n_order2, CAST(greatest(len(w) - 2, 0) AS BIGINT) AS n_order3 FROM d LEFT JOIN s ON d.r = s.r"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce((SELECT min(root) FROM reach WHERE node = d.doc_id), d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id"""

OP3 = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT vec_id, x FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
reach(node, root) AS (SELECT a, a FROM link UNION SELECT e.b, r.root FROM reach r JOIN link e ON e.a = r.node),
c AS (SELECT node, min(root) AS root FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM link GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(coalesce(c.root, v.vec_id), v.vec_id) AS component_id, coalesce(c.root, v.vec_id) >= v.vec_id AS kept FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.node = v.vec_id"""

_BYTES = "flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [195, ord(c) - 64] END))"

OP11 = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-z\u00C0-\u00FF]+')) AS w FROM documents) WHERE length(w) >= 7 GROUP BY ALL),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1])), 4294967295) AS h FROM r, tab),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) ELSE w END AS word, n FROM h) WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS s FROM (SELECT word, n, CAST(unnest(range(length(word))) AS BIGINT) AS i FROM v)),
near AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.s = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.word = v.word),
walk(word, root, steps) AS (SELECT word, word, 0 FROM f UNION ALL SELECT walk.word, f.form, steps + 1 FROM walk JOIN f ON f.word = walk.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, steps) AS root FROM walk GROUP BY word)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN last ON last.word = f.word"""

OP12 = """WITH v AS (SELECT DISTINCT vec_id, list_transform(x, lambda c: CAST(floor(256 * c) AS BIGINT)) AS x FROM (SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 THEN CAST(embedding AS DOUBLE[]) END AS x FROM embeddings) WHERE x IS NOT NULL AND vec_id IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS nth FROM s)
SELECT query_id, CAST(nth AS INTEGER) AS rank, vec_id, score FROM k WHERE nth <= 5"""

ORACLES = {"op2_lm_score": OP2, "op3_embedding_dedup": OP3, "op9_jaccard_join": OP9, "op11_spelling_variants": OP11, "op12_topk_search": OP12}
