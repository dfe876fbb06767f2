"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from .common import LOWER, UPPER
from .licences import oracle as licences

LINE_DEDUP = f"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM
  (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL AND k.doc_id <> c.last) AS n_dropped,
  sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (c.key IS NULL OR k.doc_id = c.last), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY k.doc_id"""

MIXING = r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
  3.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM v),
r AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id % 1024, d.doc_id) AS n,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST(CAST('0x' || substr(md5('42:' || coalesce('s' || d.source, '')), 1, 5) AS BIGINT) AS DOUBLE) / 1048576 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(u + rate * n) - floor(u + rate * (n - 1))) AS BIGINT) AS taken FROM r"""

#: The unsigned crc32 of a short ASCII text, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({}, ''), lambda x: ord(x)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

PREFIX_TRIE = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) || lpad(to_hex(length(text)), 8, '0') AS code FROM t),
c AS (SELECT conv_id, list(code ORDER BY turn NULLS FIRST, code) AS codes FROM k GROUP BY conv_id),
p AS (SELECT c.conv_id, list_concat(coalesce(b.codes[1:h], []), c.codes[h + 1:]) AS path
  FROM (SELECT *, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM c) c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
m AS (SELECT conv_id, d, len(path) AS size, array_to_string(path[1:d], '') AS key FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM p)),
n AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (d = size), '')) AS ends,
  CASE WHEN d > 0 THEN left(key, 40 * (d - 1)) END AS up, CASE WHEN d > 0 THEN CAST('0x' || right(key, 8) AS BIGINT) ELSE 0 END AS length
  FROM m GROUP BY key, d),
q AS (SELECT up, count(*) AS children FROM n WHERE up IS NOT NULL GROUP BY up),
s AS (SELECT left(key, 40 * a) AS key, sum((n - 1) * length) AS saved, count(*) FILTER (children IS NULL) AS leaves
  FROM (SELECT n.*, q.children, unnest(range(d + 1)) AS a FROM n LEFT JOIN q ON q.up = n.key) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, o.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(q.children, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN s ON s.key = n.key LEFT JOIN q ON q.up = n.key LEFT JOIN n o ON o.key = n.up"""

COLLOCATIONS = rf"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text, row_number() OVER () AS row
  FROM documents),
p AS (SELECT lang, row, generate_subscripts(a, 1) AS piece, unnest(a) AS t FROM (SELECT *, string_split_regex(text, '[.,;:!?\x0A-\x0D]') AS a FROM d)),
w AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws[i:i + k - 1] AS ph FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k))),
f AS (SELECT lang, ph, count(*) AS a FROM g GROUP BY lang, ph),
c AS (SELECT * FROM f WHERE a >= 30 AND len(ph) > 1),
b AS (SELECT DISTINCT s.lang, s.ph FROM (SELECT lang, a, ph[i:i + k - 1] AS sub FROM
    (SELECT *, unnest(range(1, len(ph) - k + 2)) AS i FROM (SELECT *, unnest(range(2, len(ph))) AS k FROM c WHERE len(ph) > 2))) x
  JOIN c s ON s.lang = x.lang AND s.ph = x.sub WHERE 100::HUGEINT * x.a >= 80::HUGEINT * s.a),
s AS (SELECT c.lang, c.ph, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a) // (l.a + r.a) AS score
  FROM (SELECT *, unnest(range(1, len(ph))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:k] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[k + 1:]
  WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.lang = c.lang AND b.ph = c.ph)),
m AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS cut, array_to_string(ph, ' ') AS phrase FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM o JOIN (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang) USING (lang) WHERE rank <= 2000"""

ORACLES = {"op12_collocations": COLLOCATIONS, "op11_prefix_trie": PREFIX_TRIE, "op5_licences": licences(), "op9_line_dedup": LINE_DEDUP, "op10_mixing": MIXING}
