"""DuckDB SQL for the llm queries that SQL can express."""

from __future__ import annotations

_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANK = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def winnowing(documents: str = "documents") -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOW.format("text")}, '{_ALNUM}') AS w FROM {documents}),
b AS (SELECT item_id, regexp_extract_all({_LOW.format("text")}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT rid, item_id, i, dw.n FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


SUFFIX_ARRAY_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
gaps AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER o + 100 THEN 0 ELSE 1 END AS new FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gaps) GROUP BY doc_id, g),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c, max(b) AS last FROM spans GROUP BY doc_id),
keep AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k
  FROM (SELECT doc_id, h, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM spans JOIN d USING (doc_id)) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE k || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN keep USING (doc_id)"""

SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_BLANK}') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS f FROM s) WHERE f < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY p) AS k FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

def jaccard_join(documents: str = "documents", shingle: int = 5, percent: int = 80) -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("text")}, '{_BLANK}') AS w FROM {documents}),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + {shingle - 1}], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY ALL) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

_ESC = r"replace(replace(replace({0}, '\', '\b'), '<', '\l'), '>', '\g')"

CHAT_FORMATTING = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn:' || {_ESC.format("role")} || '>' || chr(10) || {_ESC.format("text")} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def source_mixing(documents: str = "documents", slots: int = 1 << 16) -> str:
    return rf"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '~' ELSE 's' || source END AS key, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{_BLANK}'))) AS BIGINT) AS size FROM {documents} GROUP BY ALL),
n AS (SELECT key, sum(size) AS s, [3, 1, 2][1 + (row_number() OVER (ORDER BY key) - 1) % 3] AS w FROM d GROUP BY key),
f AS (SELECT *, coalesce(sum(s) OVER (ORDER BY s / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  sum(w) OVER (ORDER BY s / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wr, sum(s) OVER () AS total FROM n),
g AS (SELECT *, 4 * s * wr <= (3 * total - 4 * c) * w AS capped FROM f),
l AS (SELECT min({{'c': c, 'wr': wr}}) FILTER (NOT capped) AS lv FROM g),
t AS (SELECT key, s, total, CASE WHEN capped THEN CAST(2 * s AS DOUBLE) ELSE CAST(3 * total - 4 * lv.c AS DOUBLE) / 2.0 * w / lv.wr END AS target FROM g, l),
u AS (SELECT *, sum(target) OVER (ORDER BY key) AS upto FROM t),
h AS (SELECT *, CASE WHEN total > 0 THEN CAST(round((upto - target) / (1.5 * total) * 4294967296.0) AS BIGINT) ELSE 0 END AS lo,
  CASE WHEN total > 0 THEN CAST(round(upto / (1.5 * total) * 4294967296.0) AS BIGINT) ELSE 0 END AS hi,
  CAST(greatest(1, ceil(total * 1.5 / {slots})) AS BIGINT) AS bs FROM u),
k AS (SELECT key, count(*) AS r FROM (SELECT i, (i * 2654435769) % 4294967296 AS p FROM range({slots}) x(i)) JOIN h ON p >= lo AND p < hi AND i < ceil(total * 1.5 / bs) GROUP BY key),
p AS (SELECT d.*, sum(size) OVER (PARTITION BY key ORDER BY md5(':' || doc_id), doc_id) - size AS a FROM d)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target,
  CAST(least(size, greatest(0, x - a)) + least(size, greatest(0, x - s - a)) AS BIGINT) AS taken
FROM (SELECT p.*, s, target, least(coalesce(r, 0) * bs, 2 * s) AS x FROM p JOIN h USING (key) LEFT JOIN k USING (key))"""


def exact_dedup(documents: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, {_LOW.format("text")} AS t FROM {documents})
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t) USING (t)"""

LINE_DEDUP = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS i FROM documents),
t AS (SELECT doc_id, i, list_sort(list_distinct(regexp_extract_all(line, '{_BLANK}'))) AS w FROM l),
c AS (SELECT w, len(w) AS n, min((doc_id, i)) AS f, row_number() OVER () AS c FROM t WHERE len(w) > 0 GROUP BY w),
u AS (SELECT c, n, f, unnest(w) AS k FROM c),
p AS (SELECT y.c, count(*) AS o, any_value(x.n) AS xn, any_value(y.n) AS yn FROM u x JOIN u y ON x.k = y.k AND x.f < y.f AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n GROUP BY x.c, y.c),
g AS (SELECT DISTINCT c FROM p WHERE 5 * o >= 4 * (xn + yn - o)),
r AS (SELECT doc_id, i FROM t JOIN c USING (w) WHERE (doc_id, i) <> f OR c IN (SELECT c FROM g))
SELECT d.doc_id, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(s, '') AS removed_lines
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS s FROM r GROUP BY doc_id) q USING (doc_id)"""

ORACLES = {
    "op1_winnowing": winnowing(),
    "op2_suffix_array_dedup": SUFFIX_ARRAY_DEDUP,
    "op3_substring_dedup": SUBSTRING_DEDUP,
    "op6_ngram_jaccard_join": jaccard_join(shingle=4, percent=85),
    "op7_chat_formatting": CHAT_FORMATTING,
    "op8_source_mixing": source_mixing(),
    "op9_exact_dedup": exact_dedup(),
    "op10_line_dedup": LINE_DEDUP,
}
