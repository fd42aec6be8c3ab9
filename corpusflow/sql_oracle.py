"""DuckDB SQL twins of the registered queries (the correctness oracle).

Written independently of the Spark code, in plain SQL over the driver's
views.  Helper functions only paste expression text together; every string
returned by :func:`oracle_sql` is one SELECT statement.
"""

from __future__ import annotations

from corpusflow import constants as K

WS = f"[{K.WS_CLASS}]"
NON_WS = f"[^{K.WS_CLASS}]"
NL = "chr(10)"
SEP = "'␞'"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def rx(x: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(repl)}, 'g')"


def strip_urls(x): return rx(x, f"https?://{NON_WS}+")
def strip_mentions(x): return rx(x, f"/?[ur]/[{K.WORD_CLASS}]+")
def strip_tombstones(x): return rx(x, r"\[removed\]|\[deleted\]")
def cut_edit(x): return rx(x, "(?is)edit:.*")
def collapse_ws(x): return f"trim({rx(x, WS + '+', ' ')})"
def ustrip(x): return rx(x, f"^{WS}+|{WS}+$")


def clean(x: str) -> str:
    return collapse_ws(cut_edit(strip_tombstones(strip_mentions(strip_urls(x)))))


def bits(stream: str, key: str) -> str:
    return f"('0x' || substr(md5('{K.SEED}:{stream}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


def uniform(stream: str, key: str) -> str:
    return f"({bits(stream, key)} / 4294967296.0)"


def jstr(x: str) -> str:
    """JSON string literal of x, escaping backslash, quote and newline."""
    bs, q2 = "\\", '"'
    esc = f"replace(replace(replace({x}, '{bs}', '{bs}{bs}'), '{q2}', '{bs}{q2}'), chr(10), '{bs}n')"
    return f"('{q2}' || {esc} || '{q2}')"


# ---------------------------------------------------------------------------
# shared CTEs
# ---------------------------------------------------------------------------

ART = (
    "(CASE doc_id % 7 WHEN 0 THEN ' see https://ex.org/a/b) ' WHEN 1 THEN ' by u/some_user and r/sub_1 ' "
    "WHEN 2 THEN ' [deleted] ' WHEN 3 THEN ' Edit: later note' WHEN 4 THEN ' credit: desk' "
    "WHEN 5 THEN ' your/their' || chr(160) ELSE '' END || "
    "CASE WHEN doc_id % 11 = 0 THEN ' Beep boop' ELSE '' END)"
)
TITLE = f"split_part(text, {NL}, 1)"
REST = f"substr(text, length({TITLE}) + 2)"

ITEMS = f"""items AS (
  SELECT 'd' || doc_id AS id,
         CASE WHEN doc_id % 3 = 0 THEN 'comment' ELSE 'post' END AS type,
         {TITLE} AS title,
         {REST} || {ART} AS selftext,
         CASE WHEN doc_id % 5 = 0 THEN '' ELSE {TITLE} END AS post_title,
         text || {ART} AS body,
         (doc_id * 37) % 60 AS score,
         (doc_id * 7) % 20 AS num_comments,
         CAST(NULL AS VARCHAR) AS source,
         doc_id AS ord
  FROM documents
  UNION ALL
  SELECT 'b' || item_id, 'post', '', text, NULL, NULL, 100, 0, '{K.TARGETED_SOURCE}', {1 << 40} + item_id
  FROM benchmark
)"""

FTEXT = clean("CASE WHEN type = 'post' THEN coalesce(title, '') || ' ' || coalesce(selftext, '') ELSE coalesce(body, '') END")
ST = ustrip("coalesce(selftext, '')")
MAIN = clean(
    f"CASE WHEN type = 'post' THEN (CASE WHEN length({ST}) < {K.MIN_SELFTEXT_CHARS} THEN coalesce(title, '') "
    f"ELSE coalesce(title, '') || {NL} || {NL} || {ST} END) ELSE coalesce(body, '') END"
)
TOPIC = ustrip("CASE WHEN type = 'post' THEN coalesce(title, '') ELSE coalesce(post_title, '') END")
SCORE_GATE = (
    f"((type = 'post' AND score >= {K.MIN_POST_SCORE}) OR (type <> 'post' AND score >= {K.MIN_COMMENT_SCORE}))"
)
BOT = " OR ".join(f"contains(lower(ftext), {q(m)})" for m in K.BOT_MARKERS)

PASS = f"""{ITEMS},
scored AS (SELECT *, {FTEXT} AS ftext FROM items WHERE {SCORE_GATE}),
pass AS MATERIALIZED (
  SELECT id, ord, type, {MAIN} AS text, {TOPIC} AS topic, ftext
  FROM scored
  WHERE length(ftext) BETWEEN {K.MIN_CHARS} AND {K.MAX_CHARS} AND NOT ({BOT})
)"""

DEDUP = f"""{PASS},
texts AS MATERIALIZED (SELECT text, min(ord) AS rk FROM pass GROUP BY text),
grams AS MATERIALIZED (
  SELECT rk, sz, gram, count(*) AS c FROM (
    SELECT rk, length(lower(text)) - 2 AS sz, substr(lower(text), i, 3) AS gram
    FROM (SELECT rk, text, unnest(range(1, length(lower(text)) - 1)) AS i FROM texts)
  ) GROUP BY rk, sz, gram
),
pairs AS MATERIALIZED (
  SELECT a.rk AS rk_a, b.rk AS rk_b, sum(least(a.c, b.c)) AS inter, a.sz AS sz_a, b.sz AS sz_b
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.rk < b.rk
  GROUP BY a.rk, b.rk, a.sz, b.sz
  HAVING 5 * sum(least(a.c, b.c)) > 4 * (a.sz + b.sz - sum(least(a.c, b.c)))
),
nb AS MATERIALIZED (SELECT rk_b AS rk, list(rk_a) AS earlier FROM pairs GROUP BY rk_b),
seq AS MATERIALIZED (
  SELECT t.rk, row_number() OVER (ORDER BY t.rk) AS i, coalesce(nb.earlier, []) AS earlier
  FROM texts t LEFT JOIN nb ON nb.rk = t.rk
),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS kept
  UNION ALL
  SELECT s.i, CASE WHEN list_has_any(w.kept, s.earlier) THEN w.kept ELSE list_append(w.kept, s.rk) END
  FROM walk w JOIN seq s ON s.i = w.i + 1
),
kept AS MATERIALIZED (SELECT unnest(kept) AS rk FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)),
kept_texts AS (SELECT t.text, t.rk FROM texts t JOIN kept k ON k.rk = t.rk),
deduped AS (SELECT p.* FROM pass p WHERE p.text IN (SELECT text FROM kept_texts))"""


def _tpl_values() -> str:
    rows = []
    for fam, lst in (("direct", K.DIRECT_TEMPLATES), ("topic", K.TOPIC_TEMPLATES), ("debate", K.DEBATE_TEMPLATES)):
        rows += [f"({q(fam)}, {i}, {q(t)})" for i, t in enumerate(lst)]
    return "templates(family, idx, template) AS (VALUES " + ", ".join(rows) + ")"


def _route(src: str, key: str = "ord") -> str:
    """Template choice over a relation with ``ord`` and ``topic``."""
    u_f = uniform("family", key)
    fam = (
        f"CASE WHEN {u_f} < 0.4::DOUBLE THEN 'direct' "
        f"WHEN {u_f} < 0.75::DOUBLE AND length(topic) > 0 THEN 'topic' "
        f"WHEN length(topic) > 0 THEN 'debate' ELSE 'direct' END"
    )
    n = "CASE family WHEN 'direct' THEN 8 WHEN 'topic' THEN 5 ELSE 4 END"
    return f"""{_tpl_values()},
fam AS (SELECT *, {fam} AS family FROM {src}),
routed AS (SELECT *, CAST(floor({uniform('idx', key)} * {n}) AS INTEGER) AS idx FROM fam),
chosen AS (
  SELECT r.*, t.template, replace(t.template, '{{topic}}', r.topic) AS "user"
  FROM routed r JOIN templates t ON t.family = r.family AND t.idx = r.idx
)"""


def _msgs(system: str, user: str, assistant: str) -> str:
    return f"'system:' || {system} || {SEP} || 'user:' || {user} || {SEP} || 'assistant:' || {assistant}"


SYS = q(K.DEFAULT_SYSTEM_PROMPT)

CONV = f"""conv_ex AS (
  SELECT conv_id,
         CASE WHEN max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 1 THEN ''
              ELSE 'system:' || {SYS} || {SEP} END
         || string_agg(role || ':' || text, {SEP} ORDER BY turn) AS messages,
         arg_max(text, turn) AS last_content
  FROM conversations GROUP BY conv_id
)"""

EXAMPLES = f"""{DEDUP},
{_route("deduped")},
{CONV},
examples AS (
  SELECT 'item' AS origin, ord, {_msgs(SYS, '"user"', 'text')} AS messages, text AS last_content FROM chosen
  UNION ALL
  SELECT 'synthetic', conv_id, messages, last_content FROM conv_ex
),
keyed AS (SELECT *, origin || ':' || CAST(ord AS VARCHAR) AS skey FROM examples),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY {bits('shuffle', 'skey')}, skey) - 1 AS pos, count(*) OVER () AS n
  FROM keyed
),
split AS (SELECT *, CASE WHEN pos < (n * {K.TRAIN_PERCENT}) // 100 THEN 'train' ELSE 'val' END AS split FROM ordered)"""


# ---------------------------------------------------------------------------
# payload fixtures
# ---------------------------------------------------------------------------

def listing(max_pages: int = K.MAX_PAGES_GENERAL) -> str:
    """Landed pages: every document is a child; an extra empty page pushes the
    later pages of a query with q % 7 = 3 back by one."""
    return f"""pages AS (
  SELECT q, p + CASE WHEN q % 7 = 3 AND p >= 1 THEN 1 ELSE 0 END AS page_no, doc_id, id, title, selftext, score, num_comments, kind
  FROM (
    SELECT doc_id // 60 AS q, (doc_id % 60) // 10 AS p, doc_id,
           'd' || doc_id AS id, {TITLE} AS title, {REST} AS selftext,
           (doc_id * 37) % 60 AS score, (doc_id * 7) % 20 AS num_comments,
           CASE WHEN doc_id % 13 = 0 THEN 'more' ELSE 't3' END AS kind
    FROM documents)
),
children AS (SELECT *, row_number() OVER (PARTITION BY q, page_no ORDER BY doc_id) - 1 AS pos FROM pages),
posts AS (SELECT * FROM children WHERE kind = 't3'),
page_list AS (
  SELECT q, page_no, (q % 5 = 0 AND page_no = 2) OR page_no = CASE WHEN q % 7 = 3 THEN 6 ELSE 5 END AS no_cursor
  FROM pages GROUP BY q, page_no
),
-- a page is used if every page number before it holds a page with children and a cursor
walked AS (
  SELECT a.q, a.page_no FROM page_list a
  WHERE a.page_no < {max_pages}
    AND a.page_no = (SELECT count(*) FROM page_list b WHERE b.q = a.q AND b.page_no < a.page_no AND NOT b.no_cursor)
)"""


LISTING = listing()

COMMENTS = f"""cpages AS (
  SELECT doc_id // 12 AS b, doc_id, 'c' || doc_id AS id, text AS body, (doc_id * 41) % 60 AS score,
         CASE WHEN doc_id % 13 = 0 THEN 'more' ELSE 't1' END AS kind
  FROM documents
),
comments AS (
  SELECT 'd' || (b * 12) AS post_id, cpos, id, body, score FROM (
    SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id) - 1 AS cpos
    FROM cpages WHERE kind = 't1'
  ) WHERE cpos < {K.COMMENTS_PER_POST}
)"""

COMPLETIONS = f"""shapes AS (
    SELECT doc_id // 10 AS batch,
           string_agg({jstr('text')}, ', ' ORDER BY doc_id) AS items,
           string_agg({jstr("text || ' #' || doc_id")} || ': 1', ', ' ORDER BY doc_id) AS keys,
           count(*) AS n,
           list(text ORDER BY doc_id) AS docs
    FROM documents GROUP BY 1
),
comp AS (
  SELECT batch,
         CASE batch % 6
           WHEN 0 THEN '[1, {{"x": 2}}, null, ' || items || ']'
           WHEN 1 THEN '```json' || chr(10) || '[' || items || ']' || chr(10) || '```'
           WHEN 2 THEN '```[' || items || ']'
           WHEN 3 THEN 'Here are the takes: [' || items || '] Enjoy!'
           WHEN 4 THEN '{{' || keys || '}}'
           ELSE '[' || items || ']' END AS content,
         docs
  FROM shapes
  UNION ALL
  SELECT -1 - batch, CAST(n AS VARCHAR), docs FROM shapes WHERE batch % 6 = 5
),
fenced AS (
  SELECT batch, content, s,
         CASE WHEN NOT starts_with(s, '```') THEN s
              WHEN strpos(s, chr(10)) > 0 THEN
                CASE WHEN strpos(substr(s, strpos(s, chr(10)) + 1), '```') > 0
                     THEN regexp_extract(substr(s, strpos(s, chr(10)) + 1), '(?s)^(.*)```', 1)
                     ELSE substr(s, strpos(s, chr(10)) + 1) END
         END AS text,
         starts_with(s, '```') AND strpos(s, chr(10)) = 0 AS fence_error
  FROM (SELECT batch, content, {ustrip('content')} AS s FROM comp)
),
classified AS (
  SELECT *, CASE WHEN fence_error THEN 'fence_without_newline'
                 WHEN json_valid(text) AND json_type(text) IN ('ARRAY', 'OBJECT', 'VARCHAR') THEN 'ok'
                 WHEN json_valid(text) THEN 'not_iterable'
                 WHEN length(regexp_extract(text, '(?s)\\[(.+)\\]', 1)) > 0 THEN 'fallback'
                 ELSE 'no_array' END AS status
  FROM fenced
),
arr_takes AS (
  SELECT batch, k, {ustrip('v')} AS take FROM (
    SELECT batch, k, json_extract_string(text, '$[' || k || ']') AS v,
           json_type(json_extract(text, '$[' || k || ']')) AS t
    FROM (SELECT batch, text, unnest(range(CAST(json_array_length(text) AS BIGINT))) AS k
          FROM classified WHERE status = 'ok' AND json_type(text) = 'ARRAY')
  ) WHERE t = 'VARCHAR' AND length(v) >= {K.MIN_TAKE_CHARS}
),
key_takes AS (
  SELECT batch, k, {ustrip('v')} AS take FROM (
    SELECT batch, generate_subscripts(json_keys(text), 1) AS k, unnest(json_keys(text)) AS v
    FROM classified WHERE status = 'ok' AND json_type(text) = 'OBJECT'
  ) WHERE length(v) >= {K.MIN_TAKE_CHARS}
),
fb_takes AS (
  SELECT batch, k, {ustrip('v')} AS take FROM (
    SELECT batch, generate_subscripts(m, 1) AS k, unnest(m) AS v FROM (
      SELECT batch, regexp_extract_all(regexp_extract(text, '(?s)\\[(.+)\\]', 1),
                                       '"((?:[^"\\\\]|\\\\[^\\n]){{{K.MIN_TAKE_CHARS},}})"', 1) AS m
      FROM classified WHERE status = 'fallback')
  )
),
takes AS (
  SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY k) - 1 AS pos, take, st AS status FROM (
    SELECT batch, k, take, 'ok' AS st FROM arr_takes
    UNION ALL SELECT batch, k, take, 'ok' FROM key_takes
    UNION ALL SELECT batch, k, take, 'fallback' FROM fb_takes
  )
)"""


def _takes_first() -> str:
    return f"""{COMPLETIONS},
first_takes AS (SELECT * FROM takes ORDER BY batch, pos LIMIT {K.SYNTHETIC_TARGET})"""


def oracle_sql() -> dict[str, str]:
    s: dict[str, str] = {}
    s["item_read_union"] = f"""WITH {ITEMS}
SELECT id, type, title, selftext, post_title, body, CAST(score AS DOUBLE) AS score, num_comments, source,
       CASE WHEN id LIKE 'd%' THEN 0 ELSE 2 END AS file_ord,
       row_number() OVER (PARTITION BY substr(id, 1, 1) ORDER BY ord) - 1 AS line
FROM items"""
    s["listing_explode"] = f"""WITH {LISTING}
SELECT q, page_no, pos, id, title, selftext, score, num_comments FROM posts"""
    s["comments_explode"] = f"WITH {COMMENTS} SELECT post_id, cpos, id, body, score FROM comments"
    s["top_comments"] = f"""WITH {COMMENTS}
SELECT post_id, count(*) AS n_comments, max(cpos) AS max_pos FROM comments GROUP BY post_id"""
    s["completion_extract"] = f"WITH {COMPLETIONS} SELECT batch, content FROM comp"
    s["main_text"] = f"WITH {ITEMS} SELECT id, {MAIN} AS text FROM items"
    s["filter_text"] = f"WITH {ITEMS} SELECT id, {FTEXT} AS filter_text FROM items"
    s["topic"] = f"WITH {ITEMS} SELECT id, {TOPIC} AS topic FROM items"
    s["source_tag"] = f"SELECT 'b' || item_id AS id, '{K.TARGETED_SOURCE}' AS source FROM benchmark"
    s["score_gate"] = f"WITH {ITEMS} SELECT id, type, score FROM items WHERE {SCORE_GATE}"
    s["length_gate"] = f"""WITH {ITEMS}
SELECT id, length(ft) AS n_chars FROM (SELECT id, {FTEXT} AS ft FROM items)
WHERE length(ft) BETWEEN {K.MIN_CHARS} AND {K.MAX_CHARS}"""
    s["bot_gate"] = f"""WITH {ITEMS}
SELECT id FROM (SELECT id, {FTEXT} AS ftext FROM items) WHERE {BOT}"""
    s["passes_filter"] = f"WITH {PASS} SELECT id, length(ftext) AS n_chars FROM pass"
    s["page_cutoff"] = f"WITH {LISTING} SELECT q, page_no FROM walked"
    s["generation_requests"] = f"""SELECT item_id, replace(replace({q(GENERATION_PROMPT_SQL)}, '{{count}}', '{K.GENERATION_BATCH}'), '{{topic}}', text) AS prompt,
       {q(K.GENERATION_MODEL)} AS model, {K.GENERATION_MAX_TOKENS} AS max_tokens,
       replace(replace({q(GENERATION_PROMPT_SQL)}, '{{count}}', '{K.GENERATION_BATCH}'), '{{topic}}', text) AS content
FROM benchmark"""
    s["strip_urls"] = f"SELECT page_id, {strip_urls('html')} AS html FROM pages"
    s["strip_mentions"] = f"WITH {ITEMS} SELECT id, {strip_mentions('body')} AS body FROM items"
    s["strip_tombstones"] = f"WITH {ITEMS} SELECT id, {strip_tombstones('body')} AS body FROM items"
    s["cut_edit"] = f"WITH {ITEMS} SELECT id, {cut_edit('body')} AS body FROM items"
    s["collapse_ws"] = f"SELECT doc_id, {collapse_ws('text')} AS text FROM documents"
    s["clean_text"] = f"WITH {ITEMS} SELECT id, {clean('body')} AS body FROM items"
    s["ustrip"] = f"WITH {ITEMS} SELECT id, {ustrip('selftext')} AS selftext FROM items"
    s["fence_strip"] = f"WITH {COMPLETIONS} SELECT batch, text, status FROM classified"
    s["seeded_order"] = f"WITH {PASS} SELECT ord, {bits('shuffle', 'ord')} AS u FROM pass"
    s["template_route"] = f"WITH {PASS}, {_route('pass')} SELECT ord, family, idx FROM chosen"
    s["template_fill"] = f'WITH {PASS}, {_route("pass")} SELECT ord, "user" FROM chosen'
    s["chat_messages"] = f"""WITH {PASS}, {_route("pass")}
SELECT ord, {_msgs(SYS, '"user"', 'text')} AS messages FROM chosen"""
    s["prompt_messages"] = f"""SELECT item_id, 'system:' || {SYS} || {SEP} || 'user:' || text AS messages FROM benchmark"""
    s["chat_render_hook"] = s["chat_render"] = f"""WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT conv_id, -1, 'system', {SYS} FROM conversations GROUP BY conv_id
  HAVING max(CASE WHEN role = 'system' THEN 1 ELSE 0 END) = 0
)
SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
FROM turns GROUP BY conv_id"""
    s["trigram_counts"] = f"""WITH {PASS},
texts AS (SELECT text, min(ord) AS rk FROM pass GROUP BY text),
g AS (SELECT rk, substr(lower(text), i, 3) AS gram
      FROM (SELECT rk, text, unnest(range(1, length(lower(text)) - 1)) AS i FROM texts))
SELECT t.rk, coalesce(n_grams, 0) AS n_grams, coalesce(n_distinct, 0) AS n_distinct
FROM texts t LEFT JOIN (SELECT rk, count(*) AS n_grams, count(DISTINCT gram) AS n_distinct FROM g GROUP BY rk) c
  ON c.rk = t.rk"""
    s["seen_anti"] = f"""WITH {ITEMS}
SELECT id FROM items WHERE id NOT IN (SELECT 'd' || doc_id FROM labels)"""
    s["comment_title_join"] = f"""WITH {LISTING}, {COMMENTS}
SELECT c.id, c.post_id, p.title AS post_title
FROM comments c JOIN posts p ON p.id = c.post_id
WHERE p.num_comments >= {K.MIN_COMMENTS_GENERAL}"""
    s["worklist_anti"] = """SELECT DISTINCT source || ':' || lang AS label FROM documents
WHERE source || ':' || lang NOT IN
  (SELECT source || ':' || lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))
UNION ALL SELECT '__hot__'"""
    s["id_first_wins"] = """SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1"""
    def collected_with(max_pages: int, min_comments: int) -> str:
        return f"""{listing(max_pages)}, {COMMENTS},
wposts AS (
  SELECT p.* FROM posts p JOIN walked w ON w.q = p.q AND w.page_no = p.page_no
  WHERE p.id NOT IN (SELECT 'd' || doc_id FROM labels)
),
allrows AS (
  SELECT id, 'post' AS type, q, page_no, pos, 0 AS sub, title, CAST(NULL AS VARCHAR) AS post_title, score FROM wposts
  UNION ALL
  SELECT c.id, 'comment', p.q, p.page_no, p.pos, c.cpos + 1, NULL, p.title, c.score
  FROM comments c JOIN wposts p ON p.id = c.post_id WHERE p.num_comments >= {min_comments}
),
collected AS (
  SELECT * FROM allrows WHERE id NOT IN (SELECT 'd' || doc_id FROM labels)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY q, page_no, pos, sub) = 1
)"""
    collected = collected_with(K.MAX_PAGES_GENERAL, K.MIN_COMMENTS_GENERAL)
    targeted = collected_with(K.MAX_PAGES_TARGETED, K.MIN_COMMENTS_TARGETED)
    s["collect_targeted"] = f"""WITH {targeted}
SELECT id, type, q, page_no, pos, sub, title, post_title, '{K.TARGETED_SOURCE}' AS source FROM collected"""
    s["stream_collect"] = f"WITH {collected} SELECT id, type, q, page_no, pos, sub, title, post_title, score FROM collected"
    s["stream_walks"] = f"""WITH {LISTING},
ended AS (
  SELECT q, CASE WHEN q % 7 = 3 THEN 'empty' WHEN q % 5 = 0 THEN 'last_page' ELSE 'max_pages' END AS reason,
         CASE WHEN q % 7 = 3 THEN 1 WHEN q % 5 = 0 THEN 2 ELSE {K.MAX_PAGES_GENERAL} - 1 END AS final
  FROM walked GROUP BY q
  HAVING q % 7 = 3 OR (q % 5 = 0 AND count(*) = 3) OR count(*) = {K.MAX_PAGES_GENERAL}
)
SELECT 'nba:query ' || q AS label, reason,
       CAST(max(CASE WHEN q % 6 = 1 AND p = 0 THEN 2 ELSE (q + p) % 3 END) AS BIGINT) AS run
FROM (SELECT q, reason, unnest(range(0, final + 1)) AS p FROM ended) GROUP BY q, reason"""
    s["append_replay"] = "SELECT doc_id, text FROM documents"
    s["stream_bounded"] = """SELECT DISTINCT user_id, event_type, period FROM (
  SELECT *, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 10 AS INTEGER) AS period FROM events)
WHERE event_id % 97 <> 0 OR period > 1"""
    s["id_counts"] = """SELECT run, CAST(sum(n) OVER (ORDER BY run) AS BIGINT) AS n_ids, TRUE AS within_bound FROM (
  SELECT r.run, count(f.id) AS n FROM (SELECT unnest(range(4)) AS run) r
  LEFT JOIN (SELECT doc_id // 6 AS id, min(doc_id % 4) AS run FROM documents GROUP BY 1) f ON f.run = r.run GROUP BY r.run)"""
    s["item_offset_order"] = f"""WITH {ITEMS}
SELECT id, row_number() OVER (ORDER BY ord) - 1 AS line, body FROM items WHERE id LIKE 'd%'"""
    s["prompt_file"] = f"""SELECT item_id, 'system:' || {ustrip("(SELECT text FROM benchmark ORDER BY item_id LIMIT 1)")}
  || {SEP} || 'user:' || text AS messages FROM benchmark"""
    s["request_loop"] = f"""WITH {COMPLETIONS},
per AS (SELECT c.batch, count(t.batch) AS n_takes FROM comp c LEFT JOIN takes t ON t.batch = c.batch GROUP BY c.batch),
total AS (
  SELECT batch, n_takes,
         CAST(coalesce(sum(n_takes) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS n_before,
         CAST(floor({uniform('topic', 'batch')} * (SELECT count(*) FROM benchmark)) AS BIGINT) AS idx
  FROM per
),
topics AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS idx, text AS topic FROM benchmark)
SELECT batch, topic, n_takes, n_before, least(n_takes, greatest(0, {K.SYNTHETIC_TARGET} - n_before)) AS n_used,
       n_before < {K.SYNTHETIC_TARGET} AS asked
FROM total LEFT JOIN topics USING (idx)"""
    s["distinct_ids"] = f"WITH {collected} SELECT count(DISTINCT id) AS n_ids FROM collected"
    s["collect_items"] = f"WITH {collected} SELECT id, type, q, page_no, pos, sub, title, post_title, score FROM collected"
    s["near_dup_pairs"] = f"WITH {DEDUP} SELECT rk_a, rk_b, inter, sz_a, sz_b FROM pairs"
    s["dedup_reference"] = f"WITH {DEDUP} SELECT id, ord FROM deduped"
    s["dedup_strict"] = f"WITH {DEDUP} SELECT p.id, p.ord FROM pass p JOIN kept_texts k ON k.text = p.text AND k.rk = p.ord"
    s["stage_counts"] = f"""WITH {DEDUP}
SELECT 'raw' AS stage, count(*) AS n FROM items
UNION ALL SELECT 'filtered', count(*) FROM pass
UNION ALL SELECT 'distinct_texts', count(*) FROM texts
UNION ALL SELECT 'deduped', count(*) FROM deduped"""
    s["build_counts"] = f"""WITH {EXAMPLES}
SELECT 'raw' AS stage, count(*) AS n FROM items
UNION ALL SELECT 'filtered', count(*) FROM pass
UNION ALL SELECT 'deduped', count(*) FROM deduped
UNION ALL SELECT 'synthetic', count(*) FROM conv_ex
UNION ALL SELECT split, count(*) FROM split GROUP BY split"""
    s["read_splits"] = f"""WITH {EXAMPLES}
SELECT split, row_number() OVER (PARTITION BY split ORDER BY pos) - 1 AS line, messages FROM split"""
    s["item_quarantine"] = """SELECT reason, count(*) AS n, sum(score) AS score FROM (
  SELECT unnest(['good', 'malformed_json', 'missing_type', 'post_without_title']) AS reason,
         unnest([item_id + 0.5, NULL, 1.5, NULL]) AS score FROM benchmark)
GROUP BY reason"""
    s["take_parse"] = f"WITH {COMPLETIONS} SELECT batch, pos, take FROM takes WHERE status = 'ok'"
    s["take_fallback"] = f"WITH {COMPLETIONS} SELECT batch, pos, take FROM takes WHERE status = 'fallback'"
    s["take_trim"] = f"WITH {_takes_first()} SELECT batch, pos, take FROM first_takes"
    s["take_quarantine"] = f"""WITH {COMPLETIONS}
SELECT batch, status FROM classified WHERE status IN ('fence_without_newline', 'not_iterable')"""
    prompts = "[" + ", ".join(q(p) for p in K.SYNTHETIC_USER_PROMPTS) + "]"
    s["synthetic_examples"] = f"""WITH {COMPLETIONS}
SELECT batch, pos,
       'system:' || {SYS} || {SEP} || 'user:' ||
       {prompts}[CAST(floor({uniform('prompt', "CAST(batch AS VARCHAR) || '/' || CAST(pos AS VARCHAR)")} * {len(K.SYNTHETIC_USER_PROMPTS)}) AS INTEGER) + 1]
       || {SEP} || 'assistant:' || take AS messages
FROM takes"""
    s["synth_union"] = f"WITH {EXAMPLES} SELECT origin, ord, messages FROM examples"
    s["split_exact"] = f"WITH {EXAMPLES} SELECT origin, ord, pos, split FROM split"
    s["split_filtered"] = f"""WITH {PASS},
ordered AS (
  SELECT ord, row_number() OVER (ORDER BY {bits('shuffle', "'item:' || ord")}, 'item:' || ord) - 1 AS pos, count(*) OVER () AS n FROM pass
)
SELECT ord, pos, CASE WHEN pos < (n * {K.TRAIN_PERCENT}) // 100 THEN 'train' ELSE 'val' END AS split FROM ordered"""
    s["split_hash"] = f"""WITH {EXAMPLES}
SELECT origin, ord, CASE WHEN {bits('split', 'skey')} * 100 < {K.TRAIN_PERCENT} * 4294967296 THEN 'train' ELSE 'val' END AS split
FROM keyed"""
    s["split_grouped"] = f"""WITH {EXAMPLES}
SELECT origin, ord, CASE WHEN {bits('split', 'last_content')} * 100 < {K.TRAIN_PERCENT} * 4294967296 THEN 'train' ELSE 'val' END AS split
FROM keyed"""
    s["line_count"] = f"WITH {EXAMPLES} SELECT split, count(*) AS n FROM split GROUP BY split"
    s["corpus_build"] = f"WITH {EXAMPLES} SELECT origin, ord, pos, split, messages FROM split"
    s["write_splits"] = f"WITH {EXAMPLES} SELECT split, messages FROM split"
    s["stream_new_ids"] = "SELECT DISTINCT user_id FROM events"
    s["stream_completed"] = "SELECT DISTINCT source || ':' || lang AS label FROM documents"
    # the first-wins walk is a recursive CTE
    return {k: ("WITH RECURSIVE " + v[5:] if "walk AS (" in v else v) for k, v in s.items()}


# the generation prompt used by the registered query (our own wording)
GENERATION_PROMPT_SQL = "Write {count} short, confident takes about {topic}. Answer with a JSON array of strings."
