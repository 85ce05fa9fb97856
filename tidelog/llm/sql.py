"""SQL of the queries that SQL can express, for small tables: every one of these sorts or joins what the operators avoid to."""

from __future__ import annotations

from .mixing import MIX_SQL

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

TOOL_LINKS = """
WITH c AS (SELECT *, coalesce(text, '') AS said FROM conversations),
a AS (SELECT c.*, EXISTS (SELECT 1 FROM c r WHERE r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant') AS answered,
    EXISTS (SELECT 1 FROM c q WHERE q.conv_id = c.conv_id AND q.turn = c.turn - 1 AND q.role = 'user') AS asked,
    (SELECT min(q.turn) FROM c q WHERE q.conv_id = c.conv_id AND q.turn = c.turn % 2 AND q.role = 'user') AS opening FROM c)
SELECT conv_id, turn, 0::INT AS idx, CASE role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'tool' ELSE role END AS role,
  CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE role WHEN 'user' THEN 't' || turn WHEN 'assistant' THEN 't' || (turn - 1) END AS call_id,
  CASE role WHEN 'user' THEN 'reply' END AS name,
  CASE WHEN role = 'user' THEN CASE WHEN said = '' THEN 'invalid' WHEN turn > 1 AND opening IS NULL THEN 'dangling' WHEN answered THEN 'ok' ELSE 'unanswered' END
    WHEN role = 'assistant' THEN CASE WHEN asked THEN 'ok' ELSE 'orphan' END ELSE 'message' END AS status,
  CASE WHEN role = 'user' AND said = '' THEN '/prompt: length' ELSE '' END AS errors,
  turn AS at,
  (CASE WHEN role = 'user' THEN CASE WHEN turn > 1 AND opening IS NOT NULL THEN 2 ELSE 0 END
    WHEN role = 'assistant' AND asked THEN CASE WHEN turn > 2 AND (SELECT min(q.turn) FROM c q WHERE q.conv_id = a.conv_id AND q.turn = (a.turn - 1) % 2 AND q.role = 'user') IS NOT NULL THEN 3 ELSE 1 END ELSE -1 END)::INT AS level,
  CASE role WHEN 'user' THEN '{"arguments":{' || CASE WHEN turn > 1 THEN '"opening":"$t' || (turn % 2) || '",' ELSE '' END || '"prompt":' || to_json(said)::VARCHAR || '},"id":"t' || turn || '","name":"reply"}'
    WHEN 'assistant' THEN '{"content":' || to_json(said)::VARCHAR || ',"role":"tool","tool_call_id":"t' || (turn - 1) || '"}'
    ELSE '{"content":' || to_json(said)::VARCHAR || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' END AS json
FROM a
"""

QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT r, k, w[k] || chr(31) || w[k + 1] || chr(31) || w[k + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS k FROM d WHERE len(w) > 2)),
n AS (SELECT r, k, count(*) OVER (PARTITION BY r, x) AS n FROM g),
v AS (SELECT r, count(DISTINCT k + j) AS n_repeat_words FROM n, (SELECT unnest([0, 1, 2]) AS j) WHERE n > 1 GROUP BY r),
l AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT line) AS dups FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lines, 0) AS lines,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(t, '[^a-z]', '', 'g')) AS low, length(regexp_replace(t, '[^!]', '', 'g')) AS bangs
  FROM d LEFT JOIN v ON v.r = d.r LEFT JOIN l ON l.r = d.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 4 * n_symbols > n_words OR (up > 2 * low AND up + low >= 50) OR 2 * bangs > n_words OR 2 * n_dup_lines > lines OR word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""

NEAR = f"""
WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY text) AS id, text FROM (SELECT DISTINCT coalesce(text, '') AS text FROM documents)),
w AS (SELECT id, {_WORDS} AS w FROM x),
s AS (SELECT id, md5(array_to_string(w[k:k + 4], ' ')) AS h FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM w WHERE len(w) > 0)),
c AS (SELECT id, h, count(*) AS n FROM s GROUP BY id, h),
z AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS both_n FROM c a JOIN c b ON a.h = b.h AND a.id < b.id GROUP BY a.id, b.id),
e AS (SELECT a, b FROM p JOIN z y ON y.id = a JOIN z u ON u.id = b WHERE both_n >= 0.8 * (y.n + u.n - both_n)),
f AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT id, id AS o FROM x UNION SELECT r.id, f.b FROM r JOIN f ON r.o = f.a),
k AS (SELECT id, min(o) AS class FROM r GROUP BY id),
m AS (SELECT d.doc_id, k.class FROM documents d JOIN x ON x.text = coalesce(d.text, '') JOIN k ON k.id = x.id)
SELECT doc_id, min(doc_id) OVER (PARTITION BY class) AS class_id FROM m
"""

WINDOWS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
v AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)),
n AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM v),
g AS (SELECT DISTINCT doc_id, s + j AS p FROM n, (SELECT unnest(range(20)) AS j) WHERE n > 1),
o AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
q AS (SELECT o.doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY o.p) FILTER (WHERE g.p IS NULL) AS kept FROM o LEFT JOIN g ON g.doc_id = o.doc_id AND g.p = o.p GROUP BY o.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN q ON q.doc_id = d.doc_id
"""

BYTE_WINDOWS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, s, md5(b[s:s + 399]) AS h FROM (SELECT r, b, unnest(range(1, octet_length(b) - 398)) AS s FROM d WHERE octet_length(b) >= 400)),
c AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
i AS (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS p FROM c),
j AS (SELECT r, s, sum(CASE WHEN p IS NULL OR s > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS k FROM i),
e AS (SELECT r, min(s) AS a, max(s) + 399 AS e FROM j GROUP BY r, k),
x AS (SELECT r, a, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY a), 0) AS pe FROM e),
t AS (SELECT d.r, count(*) AS n_spans, sum(e - a + 1) AS n_removed, string_agg(hex(b[pe + 1:a - 1]), '' ORDER BY a) || hex(any_value(b)[max(e) + 1:octet_length(any_value(b))]) AS kept FROM x JOIN d ON d.r = x.r GROUP BY d.r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, CASE WHEN kept IS NULL THEN sha256(b) ELSE sha256(unhex(kept)) END AS kept_sha256
FROM d LEFT JOIN t ON t.r = d.r
"""

ORACLES = {
    "op1_tool_links": TOOL_LINKS,
    "op3_quality_cascade": QUALITY,
    "op5_histogram_mix": MIX_SQL.replace("{docs}", "documents"),
    "op7_suffix_array": BYTE_WINDOWS,
    "op8_bagminhash": NEAR,
    "op9_suffix_automata": WINDOWS,
}
