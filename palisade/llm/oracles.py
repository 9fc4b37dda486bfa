"""DuckDB SQL of the operators that SQL can express, by plain comparison of all sets and all passages."""

from __future__ import annotations

LAST = (1 << 63) - 1
_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Shingle sets compared through every shared shingle; components by the closure of the links.
NGRAM_JOIN = rf"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents),
sh AS (SELECT DISTINCT r, s FROM (SELECT r, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS s FROM w)),
sizes AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS common FROM sh a JOIN sh b USING (s) WHERE a.r <> b.r GROUP BY a.r, b.r),
links AS (SELECT x, y FROM pairs JOIN sizes a ON a.r = x JOIN sizes b ON b.r = y WHERE 100 * common >= 80 * (a.n + b.n - common)),
reach(r, y) AS (SELECT r, r FROM w UNION SELECT reach.r, links.y FROM reach JOIN links ON links.x = reach.y),
least AS (SELECT reach.r, min(w.doc_id) AS component_id FROM reach JOIN w ON w.r = reach.y GROUP BY reach.r),
degree AS (SELECT x AS r, count(*) AS n_links FROM links GROUP BY x)
SELECT w.doc_id, coalesce(sizes.n, 0) AS n_shingles, least.component_id, coalesce(degree.n_links, 0) AS n_links FROM w JOIN least USING (r) LEFT JOIN sizes USING (r) LEFT JOIN degree USING (r)"""

#: Every passage of 50 words of every distinct text; equal ones in order of document and place, merged to stretches.
REPEATS = rf"""WITH d AS (SELECT DISTINCT coalesce(doc_id, {LAST}) AS doc_id, coalesce(text, '') AS text FROM documents),
f AS (SELECT md5(text) AS h, min(doc_id) AS first_id, max(doc_id) AS last_id, regexp_extract_all(any_value(text), {_WORDS}) AS ws FROM d GROUP BY md5(text)),
long AS (SELECT * FROM f WHERE len(ws) >= 50),
passages AS (SELECT h, first_id, p, md5(array_to_string(ws[p+1:p+50], ' ')) AS w FROM (SELECT *, unnest(range(0, len(ws) - 49)) AS p FROM long)),
ranked AS (SELECT h, first_id, p, row_number() OVER own = 1 AS kept, first_value(first_id) OVER own AS source, count(*) OVER (PARTITION BY w) AS places FROM passages WINDOW own AS (PARTITION BY w ORDER BY first_id, h, p)),
marked AS (SELECT *, coalesce(p > lag(p) OVER own + 50, true)::INT AS fresh FROM ranked WHERE places > 1 WINDOW own AS (PARTITION BY h, first_id, kept, source ORDER BY p)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY h, first_id, kept, source ORDER BY p ROWS UNBOUNDED PRECEDING) AS island FROM marked),
found AS (SELECT first_id AS doc_id, h, min(p) AS start_word, max(p) + 50 AS end_word, kept, source FROM islands GROUP BY h, first_id, kept, source, island
  UNION SELECT d.doc_id, h, 0, len(ws), d.doc_id = first_id, first_id FROM d JOIN long ON md5(d.text) = h WHERE first_id <> last_id)
SELECT nullif(doc_id, {LAST}) AS doc_id, start_word::INTEGER AS start_word, end_word::INTEGER AS end_word, (end_word - start_word)::INTEGER AS n_words, kept, nullif(source, {LAST}) AS first_doc_id FROM found"""


def _crc32(text: str) -> str:
    """The unsigned crc32 of a string's UTF-8 bytes, bit by bit."""
    digit = "(instr('0123456789ABCDEF', substr({h}, {at}, 1)) - 1)"
    byte = f"16 * {digit.format(h='h', at='2 * i - 1')} + {digit.format(h='h', at='2 * i')}"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda e, k: xor(e >> 1, 3988292384 * (e & 1)))"
    of_hex = f"(SELECT xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ({byte})::BIGINT)), lambda c, b: {step})) FROM (SELECT hex(encode({text})) AS h))"
    return of_hex


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RUNS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

#: Single words in 10,000 buckets; the draw by window functions over all documents.
RESAMPLING = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, {_RUNS}) AS ws FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, {_RUNS}) AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
vocabulary AS (SELECT w, {_crc32('w')} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN vocabulary USING (w) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bw JOIN vocabulary USING (w) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS big_s, (SELECT count(*) FROM bw)::DOUBLE AS big_t),
gain AS (SELECT w, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (big_s + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (big_t + 10000))))::BIGINT AS gain FROM vocabulary LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
weighed AS (SELECT r, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM dw JOIN gain USING (w) GROUP BY r),
scored AS (SELECT r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN weighed USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (r)"""


def _state(state: str, after: dict[str, str], due: str, then: str) -> str:
    """The cheapest way of a state over one turn, without inserts before it: cost, letters, repaired turns."""
    far = "{'c': 1000000000, 'a': '', 'l': []::VARCHAR[]}"
    keeps = " ".join(f"WHEN initial = '{initial}' THEN {{'c': more + {to}.c, 'a': 'K' || {to}.a, 'l': [role || ':' || text] || {to}.l}}" for initial, to in after.items())
    keep = f"CASE WHEN must THEN {far} {keeps} ELSE {far} END"
    rerole = f"CASE WHEN must THEN {far} ELSE {{'c': 1 + more + {then}.c, 'a': 'R' || {then}.a, 'l': ['{due}:' || text] || {then}.l}} END"
    return f"list_sort([{{'c': 2 + {state}.c, 'a': 'D' || {state}.a, 'l': {state}.l}}, {keep}, {rerole}])[1]"


def _inserted(state: str, due: str, then: str) -> str:
    return f"list_sort([{state}, {{'c': 5 + {then}.c, 'a': 'I' || {then}.a, 'l': ['{due}:'] || {then}.l}}])[1]"


#: Backwards over the turns of each conversation, the cheapest and ASCII-least way of every state as a whole.
REPAIR = rf"""WITH RECURSIVE c AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS harm FROM conversations),
t AS (SELECT g, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN harm = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE harm <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS p, count(*) OVER (PARTITION BY g) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM t),
f AS (SELECT *, left(role, 1) AS initial, CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM p),
e AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CASE fault WHEN 'truncated' THEN 5 ELSE 0 END AS more, coalesce(lag(initial) OVER (PARTITION BY g ORDER BY p) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM f),
w(g, p, n0, s, u, a) AS (SELECT DISTINCT g, n + 1, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}}, {{'c': 10, 'a': 'II', 'l': ['user:', 'assistant:']}}, {{'c': 5, 'a': 'I', 'l': ['assistant:']}}, {{'c': 0, 'a': '', 'l': []::VARCHAR[]}} FROM e
  UNION ALL SELECT g, p, {_inserted('n0', 'user', 'u')}, {_inserted('s', 'user', 'u')}, u, a FROM (SELECT g, p, n0, s, {_inserted('u', 'assistant', 'a')} AS u, {_inserted('a', 'user', 'u')} AS a FROM (
    SELECT g, e.p, {_state('n0', {'s': 's', 'u': 'u'}, 'user', 'u')} AS n0, {_state('s', {'u': 'u'}, 'user', 'u')} AS s, {_state('u', {'a': 'a'}, 'assistant', 'a')} AS u, {_state('a', {'u': 'u'}, 'user', 'u')} AS a FROM w JOIN e USING (g) WHERE e.p = w.p - 1))),
sums AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal FROM e GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(n0.c, 0)::BIGINT AS cost, coalesce(n0.a, '') AS audit, sha256(coalesce(array_to_string(n0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM c) LEFT JOIN (SELECT g, n0 FROM w WHERE p = 1) USING (g) LEFT JOIN sums USING (g)"""
