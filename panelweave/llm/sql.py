"""DuckDB equivalents of the queries."""

RLZ_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
p AS (
  SELECT doc_id, i, w[i] AS word,
    CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i : i + 19], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
),
r AS (
  SELECT doc_id, i, word,
    g IS NOT NULL AND row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS again
  FROM p
),
c AS (
  SELECT doc_id, i, word, coalesce(bool_or(again) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
  FROM r
),
k AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed,
    string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

SUFFIX_DEDUP = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents
),
s1 AS (SELECT doc_id, generate_subscripts(b, 1) AS i, unnest(b) AS byte FROM d),
s2 AS (SELECT *, byte || lead(byte) OVER w AS g2 FROM s1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s4 AS (SELECT *, g2 || lead(g2, 2) OVER w AS g4 FROM s2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s8 AS (SELECT *, g4 || lead(g4, 4) OVER w AS g8 FROM s4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s16 AS (SELECT doc_id, i, byte, g2, g8 || lead(g8, 8) OVER w AS g16 FROM s8 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
s50 AS (
  SELECT doc_id, i, byte, g16 || lead(g16, 16) OVER w || lead(g16, 32) OVER w || lead(g2, 48) OVER w AS g
  FROM s16 WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
f AS (SELECT g, min(doc_id) AS first_doc FROM s50 WHERE g IS NOT NULL GROUP BY g HAVING min(doc_id) < max(doc_id)),
r AS (
  SELECT doc_id, i, byte, coalesce(first_doc < doc_id, false) AS again FROM s50 LEFT JOIN f ON s50.g = f.g
),
c AS (
  SELECT doc_id, i, byte, bool_or(again) OVER (
    PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM r
),
e AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c
),
k AS (
  SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE opens) AS n_spans,
    string_agg(byte, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM e GROUP BY doc_id
)
SELECT d.doc_id, len(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

SECRET_SCAN = r"""
WITH k(kind, pattern, least, special) AS (VALUES
  (0, '(?i)(password|passwd|secret|token|api_?key)["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)', 12, false),
  (1, 'AKIA[A-Z0-9]+', 18, false),
  (2, '[0-9a-f]{16,}', 16, false),
  (3, '[A-Za-z0-9+/_-]{24,}', 24, true)
),
a AS (
  SELECT doc_id, source, kind, least, special, pattern,
    regexp_extract_all(coalesce(text, ''), pattern, 0) AS m,
    string_split_regex(coalesce(text, ''), pattern) AS g
  FROM documents, k
),
b AS (
  SELECT doc_id, source, kind, least, special, pattern, i, m[i] AS match, length(g[i]) + length(m[i]) AS step
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM a)
),
c AS (
  SELECT *, sum(step) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop,
    CASE WHEN kind = 0 THEN regexp_extract(match, pattern, 2) ELSE match END AS value
  FROM b
),
d AS (
  SELECT doc_id, source, kind, special, stop - length(match) AS start, stop, value FROM c
  WHERE length(value) >= least AND (NOT special OR
    (regexp_matches(match, '[A-Z]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[0-9]')))
),
e AS (
  SELECT * FROM d WHERE NOT special OR NOT EXISTS (
    SELECT 1 FROM d o WHERE o.doc_id = d.doc_id AND NOT o.special AND o.start < d.stop AND d.start < o.stop)
),
f AS (
  SELECT value, count(*) AS owners
  FROM (SELECT DISTINCT value, source FROM e) GROUP BY value
),
h AS (
  SELECT doc_id, kind, start, owners,
    (['assign', 'access', 'hex', 'blob'])[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS span
  FROM e JOIN f ON e.value = f.value WHERE NOT special OR owners = 1
),
s AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
    count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE owners < 3) AS n_live,
    string_agg(span, ',' ORDER BY start, kind) AS spans,
    string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base
  FROM h GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""

JACCARD_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
),
r(doc_id, root) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

MIX_SOURCES = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
),
w AS (
  SELECT source, sum(size)::BIGINT AS words, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
),
p AS (
  SELECT *, words / weight AS ratio, (1.5::DOUBLE * (sum(words) OVER ()) - coalesce(sum(words * 2) OVER (
      ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pace
  FROM w
),
t AS (
  SELECT source, words, least((words * 2)::DOUBLE,
    coalesce((SELECT arg_min(pace, ratio) FROM p WHERE pace <= words * 2 / weight), 'inf'::DOUBLE) * weight) AS target
  FROM p
),
g AS (
  SELECT *, CASE WHEN words > 0 THEN floor(target / words) ELSE 0 END::BIGINT AS whole,
    greatest(1, ceil(words / 50000))::BIGINT AS blocks FROM t
),
k AS (
  SELECT d.doc_id, d.source, size, words, target, whole, target - whole * words AS rest,
    ('0x' || substr(md5('17|' || doc_id || '|' || size), 1, 8))::BIGINT AS key,
    ('0x' || substr(md5('18|' || doc_id || '|' || size), 1, 8))::BIGINT % blocks AS block
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
),
b AS (SELECT source, block, rest, sum(size) AS held FROM k GROUP BY source, block, rest),
u AS (
  SELECT *, sum(held) OVER (PARTITION BY source ORDER BY
    ('0x' || substr(md5('19|' || coalesce(source, '~') || '|' || block), 1, 8))::BIGINT, block) AS upto FROM b
),
q AS (
  SELECT k.*, upto <= k.rest AS inside,
    CASE WHEN upto > k.rest AND upto - held <= k.rest THEN k.rest - upto + held END AS room
  FROM k JOIN u ON k.source IS NOT DISTINCT FROM u.source AND k.block = u.block
),
e0 AS (SELECT *, room AS gap, false AS extra FROM q WHERE room IS NOT NULL AND size > 0),
f1 AS (
  SELECT *, NOT extra AND size <= gap AND sum(CASE WHEN NOT extra AND size <= gap THEN size END)
    OVER (PARTITION BY source ORDER BY key, doc_id) <= gap AS fits FROM e0
),
e1 AS (
  SELECT * EXCLUDE (gap, extra, fits), extra OR fits AS extra,
    gap - coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source), 0) AS gap FROM f1
),
f2 AS (
  SELECT *, NOT extra AND size <= gap AND sum(CASE WHEN NOT extra AND size <= gap THEN size END)
    OVER (PARTITION BY source ORDER BY key, doc_id) <= gap AS fits FROM e1
),
e2 AS (
  SELECT * EXCLUDE (gap, extra, fits), extra OR fits AS extra,
    gap - coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source), 0) AS gap FROM f2
),
f3 AS (
  SELECT *, NOT extra AND size <= gap AND sum(CASE WHEN NOT extra AND size <= gap THEN size END)
    OVER (PARTITION BY source ORDER BY key, doc_id) <= gap AS fits FROM e2
),
e3 AS (
  SELECT * EXCLUDE (gap, extra, fits), extra OR fits AS extra,
    gap - coalesce(sum(CASE WHEN fits THEN size END) OVER (PARTITION BY source), 0) AS gap FROM f3
),
x AS (
  SELECT doc_id, extra OR (row_number() OVER (PARTITION BY source ORDER BY extra, abs(size - gap), key, doc_id) = 1
    AND abs(size - gap) < gap) AS extra FROM e3
)
SELECT q.doc_id, size, words AS source_size, target,
  CASE WHEN size > 0 THEN size * (whole + (inside OR coalesce(extra, false))::BIGINT) ELSE 0 END::BIGINT AS taken
FROM q LEFT JOIN x ON q.doc_id = x.doc_id
"""

TOPK_SEARCH = r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v, d.v)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

PREFIX_TRIE = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS mark
  FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv_id, list({role: role, text: text} ORDER BY turn NULLS FIRST, mark, length(text)) AS turns
  FROM said GROUP BY conv_id
),
-- CRC-32 of the id in decimal, bit by bit.
sized AS (
  SELECT conv_id, turns, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))
  ), 4294967295) % 6 AS h
  FROM own
),
rebuilt AS (
  SELECT c.conv_id, list_concat(
    CASE WHEN c.h > 0 THEN coalesce(b.turns, [])[1:c.h] ELSE [] END, c.turns[c.h + 1:]
  ) AS turns
  FROM sized c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
),
prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS prefix, len(turns) = d AS ends
  FROM rebuilt, LATERAL unnest(range(len(turns) + 1)) AS t(d)
),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN (count(*) - 1) * length(prefix[depth].text) ELSE 0 END AS saved
  FROM prefixes GROUP BY prefix, depth
),
children AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
above AS (
  SELECT n.prefix[1:d] AS prefix, n.saved, c.prefix IS NULL AS leaf
  FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix, LATERAL unnest(range(n.depth + 1)) AS t(d)
),
summed AS (SELECT prefix, sum(saved)::BIGINT AS saved_tokens, count_if(leaf)::BIGINT AS n_leaves FROM above GROUP BY prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN summed s ON s.prefix = n.prefix
LEFT JOIN children c ON c.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""

PHRASE_GRAPH = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces),
runs AS (
  SELECT lang, words[i:i + k - 1] AS run, count(*) AS a
  FROM worded, LATERAL unnest([1, 2, 3, 4]) AS s(k), LATERAL unnest(range(1, len(words) - k + 2)) AS t(i)
  GROUP BY ALL
),
totals AS (SELECT lang, sum(a)::BIGINT AS n FROM runs WHERE len(run) = 1 GROUP BY lang),
candidates AS (SELECT * FROM runs WHERE len(run) > 1 AND a >= 30),
cuts AS (
  SELECT c.lang, c.run, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a::HUGEINT + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(run))) AS k FROM candidates) c
  JOIN runs x ON x.lang = c.lang AND x.run = c.run[1:c.k]
  JOIN runs y ON y.lang = c.lang AND y.run = c.run[c.k + 1:]
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, run ORDER BY score, k) = 1),
held AS (
  SELECT lang, run[i:i + m - 1] AS run, max(a) AS longer
  FROM candidates, LATERAL unnest([2, 3]) AS s(m), LATERAL unnest(range(1, len(run) - m + 2)) AS t(i)
  WHERE len(run) > m GROUP BY ALL
),
kept AS (
  SELECT w.*, array_to_string(w.run, ' ') AS phrase FROM lowest w LEFT JOIN held h ON h.lang = w.lang AND h.run = w.run
  WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < 80::HUGEINT * w.a
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
