"""DuckDB twins of the queries that SQL can express."""

#: A repeat of at least 8 words covers what the repeated 8-word windows cover;
#: a repeat of over 60 words exists where a 61-word window is found twice.
OP10 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
win AS (
  SELECT doc_id, 5 AS k, i, array_to_string(ws[i:i + 4], ' ') AS g FROM pos WHERE i + 4 <= len(ws)
  UNION ALL
  SELECT doc_id, 8 AS k, i, array_to_string(ws[i:i + 7], ' ') AS g FROM pos WHERE i + 7 <= len(ws)
),
twice AS (SELECT doc_id, k, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k, g) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT CASE WHEN k = 5 THEN p END) AS n5, count(DISTINCT CASE WHEN k = 8 THEN p END) AS n8
  FROM (SELECT doc_id, k, unnest(range(i, i + k)) AS p FROM twice) GROUP BY doc_id
),
-- longest repeat: runs of repeated 8-word windows are long enough to check only there
cand AS (
  SELECT p.doc_id, p.i, array_to_string(p.ws[p.i:p.i + 60], ' ') AS g
  FROM pos p JOIN (SELECT doc_id, i FROM twice WHERE k = 8) t USING (doc_id, i)
  WHERE p.i + 60 <= len(p.ws)
),
long_ AS (SELECT doc_id FROM (SELECT doc_id, g, count(*) AS c FROM cand GROUP BY doc_id, g) WHERE c > 1 GROUP BY doc_id),
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (
  SELECT doc_id, sum(c - 1) AS n FROM (
    SELECT doc_id, l, count(*) AS c FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id, l)
  GROUP BY doc_id
),
f AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n5, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(cov.n8, 0) AS BIGINT) AS covered,
    long_.doc_id IS NOT NULL AS has_long
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN long_ USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
    AND NOT (100 * covered > 20 * n_words) AND NOT has_long AS kept
FROM f
"""

#: A-Z only; DuckDB's lower() would fold other letters too.
OP7 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

#: A conversation's rendered text, every turn closed, prefixes that of another
#: exactly when its turns do: each turn starts and ends with its delimiters.
OP6 = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM t),
c AS (
  SELECT conv_id, list(role || chr(31) || text ORDER BY k) AS ts, count(*) AS n_turns,
    string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS body
  FROM n GROUP BY conv_id
),
inner_ AS (SELECT DISTINCT ts[1:k] AS ts FROM c, unnest(range(1, n_turns)) AS r(k)),
g AS (SELECT ts, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ts)
SELECT c.conv_id, c.n_turns, g.n_copies, c.body AS text
FROM g JOIN c USING (conv_id) WHERE g.ts NOT IN (SELECT ts FROM inner_)
"""

#: Terms of the items against all documents; weights in doubles, the rest in
#: 64-bit integers.
OP11 = r"""
WITH raw AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
),
post AS (SELECT doc_id, term, count(*) AS tf FROM raw GROUP BY doc_id, term),
len_ AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM post GROUP BY doc_id),
tot AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM len_),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, tot),
q AS (
  SELECT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
),
qt AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY item_id, term),
s AS (
  SELECT item_id, doc_id,
    CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * nd) // l))))) AS BIGINT) AS score
  FROM qt JOIN w USING (term) JOIN post USING (term) JOIN len_ USING (doc_id), tot
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
WHERE rank <= 10
"""

#: Windows in integers: 30 * p <= 100 * n <= 90 * p.
OP13 = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
n AS (
  SELECT anchor_id, positive_id, positive_score, id AS negative_id, score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
