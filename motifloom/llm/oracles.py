"""DuckDB SQL of the queries that SQL can express: brute-force forms for tables of a few thousand rows."""

from __future__ import annotations

from motifloom.llm.quality import BOILERPLATE, SEPARATORS, TERMINAL

WORD = r"[^\x20\x09-\x0D]+"


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_SEPARATOR = _list([*SEPARATORS, "-", "--", "::", "<<", ">>"])
_TERMINAL = _list(TERMINAL)
_BOILERPLATE = "|".join(BOILERPLATE)

OP1 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT r, string_split(t, chr(10)) AS ls FROM docs),
lines AS (SELECT r, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM split),
cut AS (SELECT *, regexp_extract_all(line, '{WORD}') AS ws, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM lines),
own AS (SELECT *, len(ws) AS n, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS size FROM cut WHERE len(ws) > 0),
judged AS (SELECT *, CASE
  WHEN len(list_filter(ws, lambda w: w IN ({_SEPARATOR}))) > 0.25 * n THEN 'navigation'
  WHEN len(regexp_extract_all(line, '[^\x20\x09-\x0D]*?(?:[#*$%&<>~^=]|[!?]{{2}})[^\x20\x09-\x0D]*')) > 0.3 * n THEN 'punctuation'
  WHEN n >= 6 AND len(list_filter(ws, lambda w: right(w, 1) IN ({_TERMINAL}))) = 0 THEN 'punctuation'
  WHEN n >= 6 AND len(list_filter(ws, lambda w: w = upper(w) AND w <> lower(w))) > 0.6 * n THEN 'punctuation'
  WHEN n <= 40 AND regexp_matches(line, '(?i)({_BOILERPLATE})') THEN 'boilerplate'
  WHEN again THEN 'boilerplate' END AS failure FROM own),
by_doc AS (SELECT r, CAST(sum(size) AS BIGINT) AS total, CAST(sum(again::INTEGER) AS BIGINT) AS dup, CAST(coalesce(sum(size) FILTER (failure IS NOT NULL), 0) AS BIGINT) AS lost, count(*) FILTER (failure = 'punctuation') AS fp, count(*) FILTER (failure = 'navigation') AS fn, count(*) FILTER (failure = 'boilerplate') AS fb FROM judged GROUP BY r),
words AS (SELECT r, regexp_extract_all(t, '{WORD}') AS ws FROM docs),
triples AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM (SELECT r, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM words WHERE len(ws) >= 3))),
covered AS (SELECT r, count(DISTINCT j) AS k FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM triples WHERE k > 1) GROUP BY r),
joined AS (SELECT d.doc_id, len(w.ws) AS n, coalesce(b.total, 0) AS total, len(regexp_extract_all(d.t, '[#*$%&|<>]')) AS symbols, coalesce(b.dup, 0) AS dup, coalesce(c.k, 0) AS k, coalesce(b.lost, 0) AS lost, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(fb, 0) AS fb FROM docs d JOIN words w USING (r) LEFT JOIN by_doc b USING (r) LEFT JOIN covered c USING (r))
SELECT doc_id, n AS n_words, total AS word_chars, symbols AS n_symbols, dup AS n_dup_lines, k AS n_repeat_words, (n < 50 OR 100 * k > 50 * n) AS base_failed, NOT (n < 50 OR 100 * k > 50 * n) AND lost <= 0.5 * total AS kept, lost AS lost_chars, fp AS failed_punctuation, fn AS failed_navigation, fb AS failed_boilerplate FROM joined
"""

OP3 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(x, x) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)) >= 0.95),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE a = v.r) AS n_links, least(v.vec_id, coalesce((SELECT min(w.vec_id) FROM reach JOIN v w ON w.r = reach.b WHERE reach.a = v.r), v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce((SELECT min(w.vec_id) FROM reach JOIN v w ON w.r = reach.b WHERE reach.a = v.r), v.vec_id)) AS kept FROM v
"""

OP6 = rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('17:' || coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(md5(text), '-')) AS draw FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source),
weighed AS (SELECT *, place % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM sources),
levels AS (SELECT *, (total - coalesce(sum(cap) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM weighed WINDOW before AS (ORDER BY cap / weight::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT level FROM levels WHERE level < cap / weight::DOUBLE ORDER BY cap / weight::DOUBLE, place LIMIT 1),
aimed AS (SELECT w.*, CASE WHEN total = 0 THEN 0.0 WHEN cap <= weight * coalesce((SELECT level FROM level), 1e300) THEN cap::DOUBLE ELSE weight * (SELECT level FROM level) END AS target FROM weighed w),
queued AS (SELECT d.doc_id, d.size, a.source_size, a.target, a.place, a.total, sum(d.size) OVER (PARTITION BY a.place ORDER BY d.draw, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, row_number() OVER () AS r FROM docs d JOIN aimed a ON d.source IS NOT DISTINCT FROM a.source),
sent AS (SELECT r, size, place, total, (e * source_size + upto)::DOUBLE / target AS finish FROM queued CROSS JOIN (VALUES (0), (1), (2)) t(e) WHERE size > 0 AND e * source_size + upto - size < target),
taken AS (SELECT r, count(*) AS k FROM (SELECT r, sum(size) OVER (ORDER BY finish, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= total AS fits FROM sent) WHERE fits GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(k, 0) * size AS BIGINT) AS taken FROM queued LEFT JOIN taken USING (r)
"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {at}, 5))::INTEGER >> {shift}) & 31 AS INTEGER) + 1, 1)"
_BASE32 = " || ".join(_DIGIT.format(at=5 * g + 1, shift=s) for g in range(8) for s in (15, 10, 5, 0))

OP7 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM m
"""

OP8 = rf"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS least, row_number() OVER (ORDER BY text) AS k FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT k, regexp_extract_all(text, '{WORD}') AS ws FROM t),
s AS (SELECT k, array_to_string(ws[i : i + 4], chr(32)) AS g, count(*) AS c FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0) GROUP BY ALL),
n AS (SELECT k, sum(c) AS n FROM s GROUP BY k),
both_ AS (SELECT a.k AS a, b.k AS b, sum(least(a.c, b.c)) AS m FROM s a JOIN s b ON a.g = b.g AND a.k <> b.k GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n x ON x.k = a JOIN n y ON y.k = b WHERE m >= 0.8 * (x.n + y.n - m) - 1e-9),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
class AS (SELECT t.k, t.text, least(t.least, coalesce(min(o.least), t.least)) AS class_id FROM t LEFT JOIN reach ON reach.a = t.k LEFT JOIN t o ON o.k = reach.b GROUP BY t.k, t.text, t.least)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, d.doc_id = coalesce(c.class_id, d.doc_id) AS kept FROM documents d LEFT JOIN class c ON c.text = d.text
"""

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, string_split_regex({_ASCII_LOWER}, '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(ps) AS p FROM docs)),
total AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, ws[i : i + m - 1] AS g FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM pieces CROSS JOIN (VALUES (1), (2), (3), (4)) t(m) WHERE len(ws) >= m)),
f AS (SELECT lang, g, array_to_string(g, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, g HAVING count(*) >= 30),
cuts AS (SELECT c.lang, c.phrase, c.g, c.f AS a, k, x.f AS l, y.f AS r, (2000000 * c.f::HUGEINT) // (x.f + y.f) AS score FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inside AS (SELECT lang, g[s : s + m - 1] AS g, max(f) AS longer FROM (SELECT lang, g, f, m, unnest(range(1, len(g) - m + 2)) AS s FROM f CROSS JOIN (VALUES (2), (3)) t(m) WHERE len(g) > m) GROUP BY ALL),
own AS (SELECT s.* FROM scored s LEFT JOIN inside i ON i.lang = s.lang AND i.g = s.g WHERE coalesce(100 * i.longer::HUGEINT < 80 * s.a::HUGEINT, true)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM own)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12 = rf"""
WITH docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({_ASCII_LOWER}, '{_TERM}') AS ws FROM documents),
items AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_ASCII_LOWER}, '{_TERM}')) AS ts FROM benchmark),
size AS (SELECT d, doc_id, len(ws) AS n FROM docs WHERE len(ws) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM size),
tf AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ws) AS t FROM docs) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), total),
impact AS (SELECT tf.d, tf.t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS impact FROM tf JOIN w USING (t) JOIN size USING (d) CROSS JOIN total),
scored AS (SELECT q, item_id, d, CAST(sum(impact) AS BIGINT) AS score FROM (SELECT q, item_id, unnest(ts) AS t FROM items) JOIN impact USING (t) GROUP BY ALL HAVING sum(impact) > 0),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored JOIN size USING (d))
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

#: The other queries have no SQL form: cuts of graphs, randomness tests, BPE merges, surrogates, label propagation and
#: searches that may miss a neighbour.
ORACLES = {"op1_quality_rules": OP1, "op3_embedding_near_dedup": OP3, "op6_mixing": OP6, "op7_warc": OP7, "op8_minhash_near_dedup": OP8, "op11_collocations": OP11, "op12_lexical_search": OP12}
