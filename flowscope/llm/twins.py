"""SQL twins of the corpus queries that SQL can express, by plain means instead of the operators' methods."""

SHARDING = r"""
WITH tbl AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) AS r(n))),
b AS (SELECT doc_id, text, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size,
  CAST(concat('0x', substr(md5(coalesce(text, '')), 1, 8), substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 7)) AS BIGINT) AS key FROM documents),
k AS (SELECT *, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
s AS (SELECT *, CAST(least(7, 8 * below // total) AS INTEGER) AS shard FROM k),
h AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST(concat('0x', x) AS BIGINT)) AS bytes FROM documents)
SELECT s.doc_id, s.size, CASE WHEN s.text IS NOT NULL THEN xor(4294967295, list_reduce(list_concat([4294967295], h.bytes), lambda a, x: xor(a >> 8, t[CAST((xor(a, x) & 255) + 1 AS BIGINT)]))) END AS text_crc32,
  'bytes' AS law, s.shard, row_number() OVER (PARTITION BY s.shard ORDER BY s.key, s.doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN h ON s.doc_id = h.doc_id, tbl
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
i AS (SELECT min(item_id) AS item_id, ws, CASE WHEN len(ws) >= 12 THEN 12 ELSE len(ws) END AS size, CASE WHEN len(ws) >= 12 THEN 2 ELSE 0 END AS most
  FROM b WHERE len(ws) >= 8 GROUP BY ws),
dt AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
it AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM i),
m AS (SELECT doc_id, item_id, p - q AS diagonal, q FROM dt JOIN it USING (word)),
g AS (SELECT doc_id, item_id, diagonal FROM m GROUP BY ALL HAVING count(*) >= 8),
z AS (SELECT m.*, i.size, i.most, greatest(1, 1 - diagonal) AS low, least(len(i.ws), len(d.ws) - diagonal) AS high
  FROM m JOIN g USING (doc_id, item_id, diagonal) JOIN i USING (item_id) JOIN d USING (doc_id)),
s AS (SELECT z.doc_id, z.item_id, z.diagonal, z.q - k AS start, any_value(z.size) AS size
  FROM z JOIN z AS o ON z.doc_id = o.doc_id AND z.item_id = o.item_id AND z.diagonal = o.diagonal, range(0, 3) AS t(k)
  WHERE k <= z.most AND z.q - k >= z.low AND z.q - k + z.size - 1 <= z.high AND o.q BETWEEN z.q - k AND z.q - k + z.size - 1
  GROUP BY z.doc_id, z.item_id, z.diagonal, z.q, k HAVING count(*) >= any_value(z.size - z.most)),
c AS (SELECT doc_id, item_id, diagonal, start + j AS q FROM s, range(0, 12) AS t(j) WHERE j < size GROUP BY ALL),
r AS (SELECT doc_id, list_sort(list(DISTINCT item_id)) AS item_ids, count(*) AS n FROM c GROUP BY doc_id)
SELECT d.doc_id, r.n IS NOT NULL AS contaminated, coalesce(r.item_ids, []) AS item_ids, CAST(coalesce(r.n, 0) AS BIGINT) AS overlap_tokens
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""

NEARDUP = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 3], ' ')) AS shingle FROM x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS both FROM s AS l JOIN s AS r ON l.shingle = r.shingle AND l.doc_id <> r.doc_id
  GROUP BY ALL),
e AS (SELECT b.a, b.b FROM b JOIN n AS l ON b.a = l.doc_id JOIN n AS r ON b.b = r.doc_id WHERE 100 * b.both >= 80 * (l.n + r.n - b.both)),
t AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS least FROM t GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.least, w.doc_id)) AS component_id,
  w.doc_id <= coalesce(m.least, w.doc_id) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.doc_id
"""

WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS least FROM p WHERE strlen(payload) >= 100 GROUP BY payload)
SELECT p.page_id, CAST(strlen(p.payload) AS BIGINT) AS payload_bytes, sha256(p.payload) AS payload_digest,
  CASE WHEN p.page_id <> f.least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id <> f.least THEN f.least END AS refers_to
FROM p LEFT JOIN f ON p.payload = f.payload
"""

SUBSTRING = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS win FROM x),
r AS (SELECT win FROM k GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, i + j AS i FROM k JOIN r USING (win), range(0, 35) AS t(j)),
o AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT o.doc_id, count(c.i) AS n, string_agg(o.word, ' ' ORDER BY o.i) FILTER (WHERE c.i IS NULL) AS kept
  FROM o LEFT JOIN c ON o.doc_id = c.doc_id AND o.i = c.i GROUP BY o.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(g.kept, '')) AS kept_sha256
FROM w LEFT JOIN g ON w.doc_id = g.doc_id
"""

NEGATIVES = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> s.own AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

PERIODIC = r"""
WITH tbl AS (SELECT list(c ORDER BY n) AS t FROM (SELECT n, list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS c FROM range(256) AS r(n))),
o AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))),
    lambda a, x: xor(a >> 8, t[CAST((xor(a, x) & 255) + 1 AS BIGINT)]))) AS h FROM documents, tbl),
g AS (SELECT doc_id, ws, len(ws) AS n, h, h // 10 AS g, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a FROM o),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: CASE WHEN i < a THEN ws[i + 1] ELSE ws[a + (i - a) % p + 1] END) ELSE ws END AS ws FROM q),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 15], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 14)) AS i FROM w WHERE len(ws) >= 24)),
e AS (SELECT l.doc_id, l.i, l.i - r.i AS lag FROM k AS l JOIN k AS r ON l.doc_id = r.doc_id AND l.win = r.win AND r.i < l.i),
m AS (SELECT doc_id, lag, min(i) - lag - 1 AS start, count(*) + 15 + lag AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM e) GROUP BY doc_id, lag, island),
r AS (SELECT doc_id, start, length, min(lag) AS period FROM m WHERE length >= greatest(24, 3 * lag) GROUP BY doc_id, start, length),
b AS (SELECT doc_id, start, length, period FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
l AS (SELECT doc_id, count(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines FROM r GROUP BY doc_id),
x AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
d AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
c AS (SELECT d.doc_id, string_agg(word, ' ' ORDER BY d.i) AS kept FROM d LEFT JOIN x ON d.doc_id = x.doc_id AND d.i = x.i WHERE x.i IS NULL GROUP BY d.doc_id)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN l ON w.doc_id = l.doc_id LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN c ON w.doc_id = c.doc_id
"""

SQL = {
    "op2_sharding": SHARDING,
    "op4_decontamination": DECONTAMINATION,
    "op8_neardup": NEARDUP,
    "op9_warc": WARC,
    "op10_substring": SUBSTRING,
    "op12_negatives": NEGATIVES,
    "op13_periodic": PERIODIC,
}
