"""SQL, for another engine, of what three operators return: none of it follows the operators' own methods."""

_CRC_TABLE = "SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS c FROM range(256) r(i))"


def _crc(text: str) -> str:
    """CRC-32 of a text of ASCII characters, with crc from the table above in scope."""
    bytes_of = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_of}), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"


#: Every pair of equal words of a document, by distance; a stretch of pairs without a gap is a run.
PERIODIC_SQL = rf"""
WITH tab AS ({_CRC_TABLE}),
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("doc_id::VARCHAR")} AS h FROM documents, tab),
l AS (SELECT *, len(w) AS n, h // 10 AS g FROM w),
l2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a FROM l),
l3 AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM l2),
x AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) END AS w FROM l3),
pos AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM x),
eq AS (SELECT s.doc_id, t.i - s.i AS q, s.i FROM pos s JOIN pos t ON s.doc_id = t.doc_id AND s.word = t.word AND t.i > s.i AND t.i - s.i <= s.n // 2),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isl FROM eq),
per AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isl GROUP BY doc_id, q, isl HAVING count(*) + q >= greatest(12, 2 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM per GROUP BY doc_id, start, length),
agg AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
    first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) AS best FROM r GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt FROM pos ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.start::BIGINT AS start, best.length::BIGINT AS length, best.period::BIGINT AS period,
  (1000 * best.length // best.period)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM x LEFT JOIN agg USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Sizes of all intersections by a join on shingles; components by transitive closure.
CIRCULANT_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
near AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT doc_id AS node, doc_id AS top FROM s UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON r.top = l.a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, c.component_id, doc_id = c.component_id AS kept
FROM s JOIN (SELECT node, min(top) AS component_id FROM reach GROUP BY node) c ON s.doc_id = c.node
"""

#: Prefixes as lists of turns; subtrees by listing every node under each of its prefixes.
TRIE_SQL = rf"""
WITH tab AS ({_CRC_TABLE}),
o AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY turn NULLS FIRST, r, x) AS turns FROM o GROUP BY conv_id),
hc AS (SELECT conv.*, {_crc("conv_id::VARCHAR")} % 4 AS h FROM conv, tab),
reb AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.turns, 1, c.h), []), list_slice(c.turns, c.h + 1, len(c.turns))) AS t
  FROM hc c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 20),
pre AS (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM reb),
m AS (SELECT conv_id, d, list_slice(t, 1, d) AS p, len(t) = d AS ends FROM pre),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ids FROM m GROUP BY p, d),
v AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].x, '[^\x20\x09-\x0D]+')) END AS saved FROM node),
kid AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
k AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kid USING (p)),
up AS (SELECT saved, n_children, p, unnest(range(d + 1)) AS k FROM k),
sub AS (SELECT list_slice(p, 1, k) AS p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM up GROUP BY 1)
SELECT k.conv_id, k.d::BIGINT AS depth, par.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
  sub.n_leaves::BIGINT AS n_leaves, sub.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(k.ids, '')) AS ends_sha256
FROM k JOIN sub ON k.p = sub.p LEFT JOIN node par ON k.d > 0 AND par.p = list_slice(k.p, 1, k.d - 1)
"""
