"""DuckDB SQL of normal forms, variants, the typo ladder and canonical texts, written from the fixed values on their own.

Texts of the donations are ASCII, so normalisation here is that of ASCII texts; documents are handled by _over_documents.
"""

from __future__ import annotations

from palisade.functions import fixed_values as fixed
from palisade.operators.typo import EVERYDAY
from palisade.plans import oracles as O
from palisade.plans.salted import DONATIONS_SQL, quoted


def listed(values) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def rewritten(x: str, pattern: str, change: str) -> str:
    """x with every match z[2] of the pattern changed."""
    return f"array_to_string(list_transform(list_zip(regexp_split_to_array({x}, '{pattern}'), list_concat(regexp_extract_all({x}, '{pattern}'), [''])), lambda z: z[1] || {change}), '')"


_APART = fixed.SET_APART


def tight(name: str, source: str, x: str, where: str = "true") -> str:
    """CTEs up to name: source with a column `tight`."""
    step = "regexp_replace(z[2], '[^a-z0-9]+', '', 'g')"
    return f"""{name}_1 AS (SELECT *, {rewritten(x, _APART[0], step)} AS {name}_a FROM {source} WHERE {where}), {name}_2 AS (SELECT *, {rewritten(f'{name}_a', _APART[1], step)} AS {name}_b FROM {name}_1),
{name} AS (SELECT * EXCLUDE ({name}_a, {name}_b), {rewritten(f'{name}_b', _APART[2], step)} AS tight FROM {name}_2)"""


def collapsed(name: str, source: str, key: str, x: str) -> str:
    """CTEs up to name(key, x): runs of three or more of a character, but for line ends, as two."""
    return f"""{name}_1 AS (SELECT {key}, z[1] AS c, z[2] AS i FROM (SELECT {key}, unnest(list_zip(regexp_extract_all({x}, '(?s:.)'), range(1, length({x}) + 1))) AS z FROM {source})),
{name}_2 AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, c ORDER BY i) AS g FROM {name}_1),
{name}_3 AS (SELECT *, row_number() OVER (PARTITION BY {key}, c, g ORDER BY i) AS k, count(*) OVER (PARTITION BY {key}, c, g) AS n FROM {name}_2),
{name} AS (SELECT {key}, string_agg(c, '' ORDER BY i) AS x FROM {name}_3 WHERE NOT (n >= 3 AND k > {fixed.MAX_REPEAT} AND c NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233))) GROUP BY {key})"""


PUNCTUATION = r"regexp_replace({}, '([.!?,;:~\-]){{2,}}', '\1', 'g')"


def normal(name: str, source: str, key: str, x: str) -> str:
    """CTEs up to name(key, n): the plain reading of ASCII texts."""
    runs = collapsed(f"{name}_r", f"(SELECT {key}, translate({x}, '$', 'S') AS x FROM {source})", key, "x")
    bare = PUNCTUATION.format("regexp_replace(x, '[\\[\\]{}]', '', 'g')")
    return f"{runs}, {name} AS (SELECT {key}, lower(trim(regexp_replace({bare}, '\\s+', ' ', 'g'))) AS n FROM {name}_r)"


def ladder(tokens: str) -> str:
    """CTEs up to laddered(raw, kind, match) of a relation of tokens `raw`."""
    most = "CASE WHEN length(f) < 5 THEN 0 WHEN length(f) < 7 THEN 1 ELSE 2 END"
    shared = "len(list_filter(range(1, least(length(f), length(word)) + 1), lambda i: left(f, i) = left(word, i)))"
    folds = [f"translate(token, '{a}', '{b}')" for a, b in (fixed.LEET_I, fixed.LEET_L)]
    best = f"row_number() OVER (PARTITION BY token ORDER BY k, levenshtein(f, word), {shared} DESC, length(word) DESC, ord) AS n"
    near = f"{most} > 0 AND abs(length(f) - length(word)) <= {most} AND levenshtein(f, word) <= {most}"
    return f"""lt AS (SELECT DISTINCT raw, regexp_replace(lower(trim(raw)), '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g') AS token FROM {tokens}),
real AS (SELECT DISTINCT token FROM lt WHERE token <> '' AND NOT regexp_matches(token, '^[0-9]+$')),
plain_forms AS (SELECT token, 0 AS k, token AS x FROM real UNION ALL SELECT token, 2, {folds[0]} FROM real UNION ALL SELECT token, 3, {folds[1]} FROM real),
{tight('tight_forms', 'plain_forms', 'x')}, all_forms AS (SELECT token, k, x AS f FROM plain_forms UNION ALL SELECT token, CASE k WHEN 0 THEN 1 ELSE k + 2 END, tight FROM tight_forms WHERE tight <> ''),
terms(ord, word) AS (VALUES {O.values(list(enumerate(fixed.SENSITIVE)))}), dictionary(ord, word) AS (VALUES {O.values(list(enumerate(EVERYDAY)))}),
step1 AS (SELECT token, arg_min(f, k) AS match FROM all_forms WHERE f IN (SELECT word FROM terms) GROUP BY token),
step3 AS (SELECT token, arg_min(f, k) AS match FROM all_forms WHERE f IN (SELECT word FROM dictionary) GROUP BY token),
step4 AS (SELECT token, word AS match, {best} FROM all_forms, terms WHERE {near}),
step5 AS (SELECT token, word AS match, {best} FROM all_forms, dictionary WHERE NOT regexp_matches(f, '[0-9]') AND left(f, 1) = left(word, 1) AND {near}),
laddered AS (SELECT lt.raw, CASE WHEN step1.token IS NOT NULL THEN 'sensitive-exact' WHEN lt.token IN (SELECT word FROM dictionary) THEN 'exact' WHEN step3.token IS NOT NULL THEN 'normalized' WHEN a.token IS NOT NULL THEN 'sensitive-fuzzy' WHEN b.token IS NOT NULL THEN 'fuzzy' ELSE 'unknown' END AS kind,
  coalesce(step1.match, CASE WHEN lt.token IN (SELECT word FROM dictionary) THEN lt.token END, step3.match, a.match, b.match) AS match
  FROM lt LEFT JOIN step1 USING (token) LEFT JOIN step3 USING (token) LEFT JOIN step4 a ON a.token = lt.token AND a.n = 1 LEFT JOIN step5 b ON b.token = lt.token AND b.n = 1)"""


def canonical(name: str, source: str, key: str, x: str) -> str:
    """CTEs up to name(key, canonical): tokens replaced by their matches, white space kept."""
    return f"""{name}_p AS (SELECT {key}, z[1] AS raw, z[2] AS i FROM (SELECT {key}, unnest(list_zip(regexp_extract_all({x}, '\\s+|\\S+'), range(1, len(regexp_extract_all({x}, '\\s+|\\S+')) + 1))) AS z FROM {source})),
{ladder(f"(SELECT DISTINCT raw FROM {name}_p WHERE trim(raw) <> '')")},
{name} AS (SELECT {key}, string_agg(CASE WHEN trim(p.raw) = '' THEN p.raw ELSE coalesce(l.match, lower(trim(p.raw))) END, '' ORDER BY i) AS canonical FROM {name}_p p LEFT JOIN laddered l ON l.raw = p.raw GROUP BY {key})"""


def _smart(x: str) -> str:
    return f"coalesce(array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN {x}[i] IN ('@','$','!','|') THEN translate({x}[i], '@$!|', 'asii') WHEN {x}[i] IN ('0','1','3','4','5','6','7','8') AND i > 1 AND i < length({x}) AND regexp_matches({x}[i-1], '[a-zA-Z]') AND regexp_matches({x}[i+1], '[a-zA-Z]') THEN translate({x}[i], '01345678', 'oieasgtb') ELSE {x}[i] END), ''), '')"


_JOINED = "regexp_replace(z[2], '\\s+', '', 'g')"
_GOOD = f"list_contains({listed(fixed.BRANDS)}, {_JOINED}) OR (list_contains({listed(fixed.STEMS)}, regexp_extract({_JOINED}, '^[a-z]+')) AND NOT regexp_matches(regexp_extract({_JOINED}, '[0-9]+$'), '^[1-9]0+$'))"
_CLOSED = rewritten("v", r"\b[a-z]{2,8}\s+\d{2,4}\b", f"CASE WHEN {_GOOD} THEN {_JOINED} ELSE z[2] END")
_WORDS = "trim(regexp_replace({}, '[^a-zA-Z0-9]+', ' ', 'g'))"
_folds = " UNION ALL ".join(f"SELECT t, {i}, translate(n, '{a}', '{b}') FROM read" for i, (a, b) in enumerate((fixed.LEET_I, fixed.LEET_L, fixed.LEET_KEEP_468), 1))


def _forms(name: str, source: str, x: str, base: int) -> str:
    turns = ", ".join(f"({i}, {v})" for i, v in enumerate((x, "tight", _WORDS.format(x))))
    return f"{tight(f'{name}_t', source, x)}, {name} AS (SELECT t, {base} + 3 * s + k AS o, v FROM {name}_t, LATERAL (VALUES {turns}) AS f(k, v) WHERE v <> '')"


def full_texts(donations: str) -> str:
    """CTEs up to seen(t, o, v): the variants of all distinct texts of the donors and messages of the CTE donations."""
    return f"""WITH {donations}, texts AS (SELECT DISTINCT x AS t FROM {O._both}), {normal('read_all', 'texts', 't', 't')}, read AS (SELECT * FROM read_all WHERE n <> ''),
{canonical('canon', 'read', 't', 'n')},
seeds(t, s, x) AS (SELECT t, 0, n FROM read UNION ALL {_folds} UNION ALL SELECT t, 4, {_smart('n')} FROM read UNION ALL SELECT t, 5, canonical FROM canon),
{_forms('first_forms', "(SELECT * FROM seeds WHERE x <> '')", 'x', 0)}, first_seen AS (SELECT t, min(o) AS s, v FROM first_forms GROUP BY t, v),
closed AS (SELECT t, s, {_CLOSED} AS c FROM first_seen WHERE v <> {_CLOSED}), {_forms('closed_forms', 'closed', 'c', 100_000)},
seen AS (SELECT t, min(o) AS o, v FROM (SELECT t, s AS o, v FROM first_seen UNION ALL SELECT * FROM closed_forms) GROUP BY t, v)"""

FULL_TEXTS = full_texts(DONATIONS_SQL)
_text = "trim(regexp_replace(regexp_replace(coalesce(nullif(n, ''), lower(trim(t))), '[|/\\\\\\[\\]{}<>*_~`]+', ' ', 'g'), '\\s+', ' ', 'g'))"
#: The same and scored(t, g): what the stub classifier says of both fields joined.
_joint = "concat_ws(' ', nullif(donator, ''), nullif(message, ''))"
SCORED_TEXTS = f"{FULL_TEXTS}, joints AS (SELECT DISTINCT {_joint} AS t FROM donations), {normal('joint_read', 'joints', 't', 't')}, scored AS (SELECT t, CASE WHEN contains({_text}, 'gacor') THEN 0.92 ELSE 0.05 END AS g FROM joint_read UNION ALL SELECT '', 0.05)"
FULL_SQL = O.decided_sql(texts=FULL_TEXTS, key="d.{}")
FULL_BOTH_SQL = O.decided_sql(f"(SELECT g FROM scored WHERE scored.t = {_joint} LIMIT 1)", SCORED_TEXTS, "d.{}")


def _plain_letters() -> list[tuple[str, str]]:
    """(character, what folds and normal forms leave of it): stated letters, then those that Unicode takes apart; nothing of the engine's table."""
    from unicodedata import category, normalize

    stated = {pair[0]: pair[1] for table in (fixed.READ_ACCENTED, fixed.READ_LATIN, fixed.READ_GREEK, fixed.READ_CYRILLIC, fixed.READ_ARMENIAN, fixed.READ_MONEY) for pair in table.split()}
    two = {chr(code) for code, _ in fixed.TWO_READINGS}
    out = {"$": "S"} | {a: b for a, b in stated.items() if a not in two}
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00)]:
        letter = chr(code)
        plain = "".join(c for c in normalize("NFKD", letter) if not category(c).startswith("M"))
        if letter not in out and letter not in two and plain != letter:
            out[letter] = plain
    return list(out.items())


def documents_read(source: str = "documents", folds: bool = True) -> str:
    """First readings of a relation (doc_id, text) whose texts hold no character with two readings; without folds only marks are stripped."""
    clean = "regexp_replace(regexp_replace(x, '{}', '', 'g'), '(?:{}|[\\x{{FE00}}-\\x{{FE0F}}])+', ' ', 'g')".format(fixed.EMOJI, fixed.PICTURES)
    bare = PUNCTUATION.format(f"regexp_replace(regexp_replace({clean}, '{fixed.ORNAMENTS}', '', 'g'), '{fixed.INVISIBLE}', '', 'g')")
    by_letter = f"""plain(c, r) AS (VALUES {O.values(_plain_letters())}), chars AS (SELECT doc_id, z[1] AS c, z[2] AS i FROM (SELECT doc_id, unnest(list_zip(regexp_extract_all(text, '(?s:.)'), range(1, length(text) + 1))) AS z FROM kinds WHERE wide)),
folded AS (SELECT doc_id, string_agg(coalesce(r, c), '' ORDER BY i) AS f FROM chars LEFT JOIN plain USING (c) GROUP BY doc_id)"""
    by_marks = "folded AS (SELECT doc_id, translate(strip_accents(text), '$', 'S') AS f FROM kinds WHERE wide)"
    return f"""WITH kinds AS (SELECT doc_id, text, regexp_matches(text, '[^\\x00-\\x7f]') AS wide FROM {source}), {by_letter if folds else by_marks}, {collapsed('once', 'folded', 'doc_id', 'f')},
{normal('narrow', '(SELECT doc_id, text FROM kinds WHERE NOT wide)', 'doc_id', 'text')},
readings AS (SELECT doc_id, lower(trim(regexp_replace({bare}, '\\s+', ' ', 'g'))) AS n FROM once UNION ALL SELECT * FROM narrow)
SELECT doc_id, md5(coalesce(n, '')) AS first, 1 AS n FROM (SELECT doc_id FROM {source}) LEFT JOIN readings USING (doc_id)"""
