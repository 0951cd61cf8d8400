"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)

#: Each window of a text's words as one string, by where its first word stands (from 1).
_WINDOWS = "unnest(list_transform(generate_series(1, greatest(len(w) - 9, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END)), lambda i: {{'pos': i, 'n': least(10, len(w)), 'key': array_to_string(w[i:i + 9], ' ')}}))"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, x.n AS n, x.key AS key FROM (SELECT item_id, {_WINDOWS.format()} AS x FROM b)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, x.pos AS pos, x.key AS key FROM (SELECT doc_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: {{'pos': i, 'key': array_to_string(w[i:i + n - 1], ' ')}})) AS x FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, pos, dw.n AS n FROM dw JOIN bw ON dw.key = bw.key AND dw.n = bw.n),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(pos, pos + n - 1)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

#: The reachable part of a graph e(a, b), both ways, by its least vertex.
_REACH = "walk(s, k) AS (SELECT a, b FROM e UNION SELECT walk.s, e.b FROM walk JOIN e ON walk.k = e.a), least AS (SELECT s, least(s, min(k)) AS c FROM walk GROUP BY s)"

OP2 = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, x, sqrt(list_sum(list_transform(x, lambda y: y * y))) AS norm FROM v),
g AS (SELECT * FROM u WHERE norm > 0 AND isfinite(norm)),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.98),
{_REACH}
SELECT m.vec_id, (SELECT count(*) FROM e WHERE e.a = m.vec_id) AS n_links, coalesce(c, m.vec_id) AS component_id, coalesce(c, m.vec_id) = m.vec_id AS kept FROM embeddings m LEFT JOIN least ON least.s = m.vec_id
"""

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * common >= 85 * (m.n + o.n - common)),
{_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.s = d.doc_id
"""

OP7 = r"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
k AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(rh, rp, verdict)),
f AS (SELECT page_id, rh || rp AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS n FROM p JOIN k ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|\.)ads-track\.example\.(com|net|org)$') AND starts_with(path, '/') THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN f ON f.page_id = p.page_id AND n = 1
"""

OP13 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, unnest(list_transform(generate_series(1, len(w) - m + 1), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m > 1),
s AS (SELECT c.lang, c.m, c.phrase, c.a, k, x.a AS l, y.a AS r, CAST(t.n AS BIGINT) AS n, CAST((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score FROM c JOIN t ON t.lang = c.lang
JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(string_split(phrase, ' ')[h:m - 2 + h], ' ') AS phrase, max(a) AS around FROM f, (SELECT unnest([1, 2]) AS h) WHERE m > 2 GROUP BY 1, 2),
r AS (SELECT b.*, b.lang AS g, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE around IS NULL OR around < a)
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000
"""

ORACLE_SQL = {"op1_decontaminate": OP1, "op2_embedding_dedup": OP2, "op4_near_dedup": OP4, "op7_url_filter": OP7, "op13_collocations": OP13}
