"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from inkwell.llm.licenses import APART, BASE, PASSAGES, SHARED, VOTES
from inkwell.llm.quality import (
    BOILERPLATE, JUDGED_WORDS, MAX_CAPITAL_WORDS, MAX_LOST, MAX_MARKS_PER_WORD, MAX_REPEATED_PCT, MAX_SYMBOLS_PER_WORD, MIN_WORDS, NOTICE_WORDS, UNENDED_WORDS,
)
from inkwell.llm.urls import RULES

OP2 = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE octet_length(body) >= 100 GROUP BY payload_digest)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND octet_length(body) >= 100
"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _templates() -> str:
    rows = [(i, label, i < len(BASE), text) for i, (label, text) in enumerate((*BASE, *PASSAGES))]
    return ", ".join(f"({i}, {_literal(label)}, {str(base).lower()}, string_split({_literal(text)}, ' '))" for i, label, base, text in rows)


OP5 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
t(template, label, base, ws) AS (VALUES {_templates()}),
q AS (SELECT template, base, len(ws) AS size, q, ws[q + 1] || ' ' || ws[q + 2] || ' ' || ws[q + 3] AS g FROM (SELECT *, unnest(range(0, len(ws) - 2)) AS q FROM t)),
p AS (SELECT r, p, ws[p + 1] || ' ' || ws[p + 2] || ' ' || ws[p + 3] AS g FROM (SELECT *, unnest(range(0, len(ws) - 2)) AS p FROM d WHERE len(ws) > 2)),
v AS (SELECT r, template, base, size, p - q AS diagonal, list(q) AS qs, min(p) AS a, max(p) AS b FROM p JOIN q USING (g) GROUP BY r, template, base, size, p - q),
x AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER w > {APART}, true)::INT AS fresh FROM v WHERE NOT base WINDOW w AS (PARTITION BY r, template ORDER BY diagonal)),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY r, template ORDER BY diagonal) AS part FROM x),
m AS (SELECT r, template, min(a) AS a, max(b) AS b, len(list_distinct(flatten(list(qs))))::DOUBLE / (any_value(size) - 2) AS votes FROM y GROUP BY r, template, part),
s AS (
  SELECT m.r, t.label, false AS base, a AS start, least(votes, shared) AS score
  FROM m JOIN d ON d.r = m.r JOIN t USING (template), LATERAL (SELECT len(list_intersect(list_distinct(t.ws), list_distinct(d.ws[a + 1 : b + 3])))::DOUBLE / len(list_distinct(t.ws)) AS shared)
  WHERE votes >= {VOTES} AND shared >= {SHARED}
  UNION ALL SELECT v.r, t.label, true, diagonal, 1.0 FROM v JOIN t USING (template) WHERE v.base AND len(qs) = size - 2),
n AS (
  SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(score) AS score,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM s GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM d LEFT JOIN n USING (r)
"""

# Probability Jaccard of all pairs whose shares of shared shingles could reach it; 0.8 and five words are fixed by the task.
OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
sh AS (SELECT doc_id, s, count(*)::DOUBLE AS x FROM (SELECT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w)) GROUP BY doc_id, s),
t AS (SELECT doc_id, md5(string_agg(s || '=' || x, '|' ORDER BY s)) AS h, sum(x) AS total FROM sh GROUP BY doc_id),
u AS (SELECT h, min(doc_id) AS id, any_value(total) AS total FROM t GROUP BY h),
us AS (SELECT id, s, x, total FROM u JOIN sh ON sh.doc_id = u.id),
near AS (SELECT a.id AS p, b.id AS q FROM us a JOIN us b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id HAVING sum(least(a.x / a.total, b.x / b.total)) >= 0.8 - 1e-9),
j AS (
  SELECT p, q, s, sum(x) AS x, sum(y) AS y
  FROM (SELECT p, q, s, x, 0 AS y FROM near JOIN us ON us.id = p UNION ALL SELECT p, q, s, 0, x FROM near JOIN us ON us.id = q) GROUP BY p, q, s),
jp AS (
  SELECT p, q, sum(1 / den) AS similarity
  FROM (SELECT i.p, i.q, i.s, sum(greatest(j.x / i.x, j.y / i.y)) AS den FROM j i JOIN j ON j.p = i.p AND j.q = i.q WHERE i.x > 0 AND i.y > 0 GROUP BY i.p, i.q, i.s) GROUP BY p, q),
e AS (SELECT p AS x, q AS y FROM jp WHERE similarity >= 0.8 - 1e-9 UNION ALL SELECT q, p FROM jp WHERE similarity >= 0.8 - 1e-9),
c(id, label) AS (SELECT id, id FROM u UNION SELECT e.y, c.label FROM c JOIN e ON e.x = c.id)
SELECT doc_id, label AS class_id FROM t JOIN u USING (h) JOIN (SELECT id, min(label) AS label FROM c GROUP BY id) k ON k.id = u.id
"""

_NOTICES = ", ".join(map(_literal, BOILERPLATE))
OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
rp AS (SELECT r, count(DISTINCT i + j) AS n FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS c FROM g) CROSS JOIN (VALUES (0), (1), (2)) z(j) WHERE c > 1 GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
k AS (
  SELECT r, line, count(*) AS times, any_value(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n, any_value(length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars FROM l GROUP BY r, line),
j AS (
  SELECT r, times, chars,
    NOT (len(regexp_extract_all(line, '[#*$%&|<>]')) > {MAX_SYMBOLS_PER_WORD} * n OR (bars >= 2 AND bars > {MAX_SYMBOLS_PER_WORD} * n) OR (n >= {JUDGED_WORDS} AND len(regexp_extract_all(line, '[!?]')) > {MAX_MARKS_PER_WORD} * n)
      OR (n >= {JUDGED_WORDS} AND len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '^\p{{Lu}}{{2,}}([!?.,;:]|$)') OR regexp_matches(x, '^\p{{Lu}}[!?]{{2}}'))) > {MAX_CAPITAL_WORDS} * n)
      OR (n <= {NOTICE_WORDS} AND len(list_filter([{_NOTICES}], lambda x: contains(lower(line), x))) > 0)
      OR (n < {UNENDED_WORDS} AND NOT regexp_matches(line, '[.!?:;\x{{2026}}\x{{3002}}\x{{ff01}}\x{{ff1f}}]["''\x{{201d}}\x{{2019}}\x{{bb}})\]]*[\x20\x09-\x0D]*$'))) AS good
  FROM k, LATERAL (SELECT len(regexp_extract_all(line, '[|»›•>]')) AS bars)),
f AS (SELECT r, sum(times) - count(*) AS dup, coalesce(sum(chars) FILTER (good), 0) AS kept FROM j GROUP BY r),
o AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, coalesce(rp.n, 0) AS n_repeat_words, coalesce(kept, 0) AS kept_chars
  FROM d JOIN w USING (r) LEFT JOIN rp USING (r) LEFT JOIN f USING (r)),
a AS (SELECT *, CASE WHEN word_chars = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - kept_chars::DOUBLE / word_chars END AS lost, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PCT} * n_words AS base_failed FROM o)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= {MAX_LOST} AS kept, round(lost, 6) AS lost_share FROM a
"""

_RULES = ", ".join(f"({_literal(v)}, {_literal(h)}, {_literal(p)})" for v, h, p in RULES)
OP10 = rf"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS a FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(a, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
u(verdict, uh, up) AS (VALUES {_RULES}),
x AS (SELECT r, arg_max(uh || up, length(uh || up)) AS rule, arg_max(verdict, length(uh || up)) AS verdict FROM h JOIN u ON (host = uh OR ends_with(host, '.' || uh)) AND starts_with(path, up) GROUP BY r),
c AS (
  SELECT h.*, rule, verdict,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{{n}}' WHEN regexp_full_match(s, '[0-9]+\.[A-Za-z0-9]+') THEN '{{n}}' || regexp_extract(s, '\.[A-Za-z0-9]+$')
           WHEN regexp_full_match(s, '[0-9a-fA-F-]{{12,}}') THEN '{{hash}}' WHEN regexp_matches(s, '[0-9]') THEN '{{name}}' ELSE s END) AS shape
  FROM h LEFT JOIN x USING (r)),
l AS (SELECT host, shape, count(*) AS pages, count(verdict)::DOUBLE AS n, (count(*) FILTER (verdict = 'block'))::DOUBLE AS b FROM c GROUP BY host, shape),
t AS (SELECT '=' || host AS tree, shape, pages, n, b FROM l UNION ALL SELECT '*', shape, sum(pages), sum(n), sum(b) FROM l GROUP BY shape),
s AS (SELECT *, shape[k] AS seg, shape[1 : k - 1] AS parent, shape[1 : k] AS node FROM (SELECT *, unnest(range(1, len(shape) + 1)) AS k FROM t)),
ra AS (
  SELECT *, NOT (sum(pages) OVER own >= 0.05::DOUBLE * sum(pages) OVER every OR sum(n) OVER own >= 5 OR starts_with(seg, '{{')) AS rare
  FROM s WINDOW own AS (PARTITION BY tree, node), every AS (PARTITION BY tree, parent)),
fo AS (SELECT *, min(k) FILTER (rare) OVER (PARTITION BY tree, shape) AS fork FROM ra),
ta AS (
  SELECT *, CASE WHEN fork IS NULL OR k < fork OR (k > fork AND (sum(pages) OVER own >= 0.05::DOUBLE * sum(pages) OVER every OR sum(n) OVER own >= 5 OR starts_with(seg, '{{'))) THEN seg ELSE '{{any}}' END AS part
  FROM fo WINDOW own AS (PARTITION BY tree, coalesce(k > fork, false), shape[1 : fork - 1], k, seg), every AS (PARTITION BY tree, coalesce(k > fork, false), shape[1 : fork - 1], k)),
te AS (SELECT tree, shape, list(part ORDER BY k) AS template FROM ta GROUP BY tree, shape),
f AS (SELECT t.*, coalesce(template, []::VARCHAR[]) AS template FROM t LEFT JOIN te ON te.tree = t.tree AND te.shape = t.shape),
nd AS (
  SELECT tree, node, node[1 : len(node) - 1] AS parent, sum(n) AS n, sum(b) AS b FROM (SELECT tree, n, b, unnest(list_transform(range(1, len(template) + 1), lambda k: template[1 : k])) AS node FROM f)
  GROUP BY tree, node HAVING sum(n) > 0),
nc AS (SELECT *, len(list_filter(range(1, 16), lambda k: b / n >= round(pow(sin(k * pi() / 32), 2), 6))) AS cell FROM nd),
ce AS (SELECT tree, parent, cell, sum(n) AS n, sum(b) AS b FROM nc GROUP BY tree, parent, cell),
la AS (SELECT *, lag(n) OVER o AS n1, lag(b) OVER o AS b1 FROM ce WINDOW o AS (PARTITION BY tree, parent ORDER BY cell)),
po AS (
  SELECT *, sum(CASE WHEN abs(b / n - b1 / n1) <= 1.96::DOUBLE * sqrt((b + b1) / (n + n1) * (1 - (b + b1) / (n + n1)) * (1 / n + 1 / n1)) THEN 0 ELSE 1 END) OVER (PARTITION BY tree, parent ORDER BY cell) AS pool FROM la),
pc AS (SELECT tree, parent, cell, sum(n) OVER w AS n, sum(b) OVER w AS b FROM po WINDOW w AS (PARTITION BY tree, parent, pool)),
ef AS (SELECT nc.tree, nc.node, pc.n, pc.b FROM nc JOIN pc ON pc.tree = nc.tree AND pc.parent = nc.parent AND pc.cell = nc.cell),
ro AS (SELECT tree, sum(n) AS labelled, CASE WHEN sum(n) > 0 THEN sum(b) / sum(n) ELSE 0.0 END AS root FROM t GROUP BY tree),
sh(tree, template, d, share, labelled) AS (
  SELECT f.tree, f.template, 0, root::DOUBLE, labelled FROM (SELECT DISTINCT tree, template FROM f) f JOIN ro ON ro.tree = f.tree
  UNION ALL SELECT sh.tree, sh.template, d + 1, (coalesce(ef.b, 0) + 5.0::DOUBLE * share) / (coalesce(ef.n, 0) + 5.0::DOUBLE), labelled FROM sh LEFT JOIN ef ON ef.tree = sh.tree AND ef.node = sh.template[1 : d + 1] WHERE d < len(sh.template)),
own AS (SELECT f.tree, f.shape, share, least(labelled, 100.0::DOUBLE) AS weight FROM f JOIN sh ON sh.tree = f.tree AND sh.template = f.template AND d = len(sh.template)),
j AS (SELECT substr(a.tree, 2) AS host, a.shape, (a.share * a.weight + 5.0::DOUBLE * o.share) / (a.weight + 5.0::DOUBLE) AS share FROM own a JOIN own o ON o.tree = '*' AND o.shape = a.shape WHERE a.tree <> '*')
SELECT page_id, c.host, path, rule, coalesce(verdict, CASE WHEN share >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN verdict IS NULL THEN round(share, 6) END AS share FROM c JOIN j ON j.host = c.host AND j.shape = c.shape
"""

OP11 = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s) WHERE rank <= 5
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len({text}) + 1), lambda i: ascii({text}[i])::BIGINT)), lambda c, b: {byte}), 4294967295::BIGINT)"


def _encoded(*values: str) -> str:
    return " || ".join(f"coalesce(octet_length(encode(CAST({v} AS VARCHAR))) || ':' || CAST({v} AS VARCHAR), '-')" for v in values)


OP12 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars, sha256({_encoded("doc_id", "source", "lang", "n_chars", "text")}) AS leaf,
         sha256({_encoded("doc_id", "source", "lang", "CAST(n_chars AS HUGEINT) + 1", "text")}) AS changed FROM documents),
p AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM d),
t(g, lvl, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM p
  UNION ALL
  SELECT g, lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, lvl, i // 2, n),
s AS (SELECT g, h, lvl FROM t WHERE n = 1),
u(lvl, i, n, h) AS (
  SELECT 0, g, count(*) OVER (), h FROM s
  UNION ALL
  SELECT lvl + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY lvl, i // 2, n),
siblings AS (
  SELECT p.r, t.lvl, t.h, (p.i >> t.lvl) % 2 AS side FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.i = xor(p.i >> t.lvl, 1)
  UNION ALL
  SELECT p.r, 1000 + u.lvl, u.h, (p.g >> u.lvl) % 2 FROM p JOIN u ON u.n > 1 AND u.i = xor(p.g >> u.lvl, 1)),
steps AS (
  SELECT p.r, x.lvl, s.h, s.side FROM p
  JOIN (SELECT DISTINCT g, lvl FROM t WHERE n > 1 UNION SELECT s.g, 1000 + u.lvl FROM s CROSS JOIN (SELECT DISTINCT lvl FROM u WHERE n > 1) u) x ON x.g = p.g
  LEFT JOIN siblings s ON s.r = p.r AND s.lvl = x.lvl),
numbered AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY lvl) AS k FROM steps),
folded(r, k, h) AS (
  SELECT r, 0, CASE WHEN n_chars IS NOT NULL AND {_crc32('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN changed ELSE leaf END FROM p
  UNION ALL
  SELECT f.r, f.k + 1, sha256(CASE WHEN s.side = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END) FROM folded f JOIN numbered s ON s.r = f.r AND s.k = f.k + 1),
proofs AS (SELECT r, sha256(coalesce(string_agg(h, '' ORDER BY lvl), '')) AS proof_sha256 FROM steps GROUP BY r),
ends AS (SELECT r, arg_max(h, k) AS folded_root FROM folded GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, (SELECT h FROM u WHERE n = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT h FROM u WHERE n = 1) AS verified
FROM p JOIN s ON s.g = p.g JOIN ends ON ends.r = p.r LEFT JOIN proofs ON proofs.r = p.r
"""

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} AS h,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
a AS (SELECT *, len(ws) AS n, (h // 10) % greatest(len(ws), 1) AS a FROM d),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS q FROM a),
t AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % q + 1] END) ELSE ws END AS ws FROM q),
w AS (SELECT r, n, unnest(range(0, n)) AS i, unnest(ws) AS w FROM t),
same AS (SELECT x.r, y.i - x.i AS p, x.i FROM w x JOIN w y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND y.i - x.i <= x.n // 3),
islands AS (SELECT r, p, min(i) AS start, count(*) AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY r, p ORDER BY i) AS k FROM same) GROUP BY r, p, k),
runs AS (SELECT r, start, m + p AS length, min(p) AS period FROM islands WHERE m >= greatest(24 - p, 2 * p) GROUP BY r, start, m + p),
best AS (SELECT r, start, length, period, row_number() OVER (PARTITION BY r ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs),
lines AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS words FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM t LEFT JOIN lines USING (r) LEFT JOIN kept USING (r) LEFT JOIN best ON best.r = t.r AND best.k = 1
"""
