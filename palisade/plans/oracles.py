"""DuckDB SQL of the evidence and the decision, written from the rule tables on their own."""

from __future__ import annotations

from palisade.functions import fixed_values as fixed
from palisade.functions.patterns import has_re2, phrase, re2
from palisade.plans.salted import DONATIONS_SQL, quoted

KINDS = {"hard": fixed.HARD_RULES, "promo": fixed.PROMO_RULES, "weak": fixed.WEAK_RULES, "suspicious": fixed.SUSPICIOUS_RULES}
#: Rules with look-ahead: words that the pattern finds, without those that it excludes.
EXCLUDED = {
    "brand-suffix-token": (r"\b[a-z]{2,}(?:toto|togel|slot|bandar)\d*\b", ("timeslot",)),
    "brand-bola-token": (r"\b[a-z]{3,}bola\d*\b", ("sepakbola", "basketbola", "lapanganbola", "bermainbola")),
}
PHRASES = {"denounce": fixed.ANTI_PHRASES, "gaming": fixed.GAMING_PHRASES, "general": fixed.GENERAL_PHRASES, "strong": fixed.STRONG_GAMING_PHRASES}


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(quoted(v) if isinstance(v, str) or v is None else str(v) for v in row) + ")" for row in rows)


_rules = [(k, i, name, re2(p), w) for k, rules in KINDS.items() for i, (name, p, w) in enumerate(rules) if has_re2(p)]
_special = [(k, i, name, EXCLUDED[name][0], w) for k, rules in KINDS.items() for i, (name, p, w) in enumerate(rules) if not has_re2(p)]
_excluded = ", ".join(quoted(w) for _, words in EXCLUDED.values() for w in words)
#: seen(t, o, v) must stand before: variants v of the texts t, in order o.
HITS_SQL = f"""rules(kind, ord, id, pattern, weight) AS (VALUES {values(_rules)}),
special(kind, ord, id, pattern, weight) AS (VALUES {values(_special)}),
hits AS (SELECT t, kind, ord, id, arg_min(regexp_extract(v, pattern), o) AS value, weight FROM seen, rules WHERE regexp_matches(v, pattern) GROUP BY t, kind, ord, id, weight
  UNION ALL SELECT t, kind, ord, id, arg_min(found[1], o), weight FROM (SELECT t, o, kind, ord, id, weight, list_filter(regexp_extract_all(v, pattern), lambda x: NOT list_contains([{_excluded}], x)) AS found FROM seen, special) WHERE len(found) > 0 GROUP BY t, kind, ord, id, weight)"""
PHRASES_SQL = f"""phrases(kind, ord, phrase, pattern) AS (VALUES {values([(k, i, p, phrase(p).replace(chr(92) + ' ', ' ')) for k, ps in PHRASES.items() for i, p in enumerate(ps)])}),
said AS (SELECT DISTINCT t, kind, ord, phrase FROM seen, phrases WHERE regexp_matches(v, pattern))"""
BRANDS_SQL = f"""brands(ord, brand) AS (VALUES {values(list(enumerate(fixed.BRANDS)))}),
toks AS (SELECT DISTINCT t, unnest(regexp_extract_all(v, '[a-z0-9]+')) AS token FROM seen), squeezes AS (SELECT DISTINCT t, regexp_replace(v, '[^a-zA-Z0-9]+', '', 'g') AS token FROM seen),
named AS (SELECT t, ord, brand FROM toks JOIN brands ON token = brand UNION SELECT t, ord, brand FROM squeezes, brands WHERE length(brand) >= {fixed.BRAND_SUBSTRING_MIN} AND contains(token, brand)),
near_named AS (SELECT DISTINCT f.t, b.ord, b.brand FROM (SELECT * FROM toks UNION SELECT * FROM squeezes) f, brands b
  WHERE length(brand) >= {fixed.NEAR_BRAND_MIN} AND length(token) >= {fixed.NEAR_BRAND_MIN} AND abs(length(token) - length(brand)) <= {fixed.NEAR_BRAND_DISTANCE} AND token <> brand
  AND levenshtein(token, brand) <= {fixed.NEAR_BRAND_DISTANCE} AND NOT EXISTS (SELECT 1 FROM named n WHERE n.t = f.t AND n.brand = b.brand))"""
#: The lower-cased text is its only variant.
MESSAGE_TEXTS = f"WITH {DONATIONS_SQL}, texts AS (SELECT DISTINCT lower(message) AS t FROM donations WHERE coalesce(message, '') <> ''), seen AS (SELECT t, 0 AS o, t AS v FROM texts)"
_both = "(SELECT message AS x FROM donations UNION SELECT donator FROM donations) WHERE coalesce(x, '') <> ''"
PLAIN_TEXTS = f"WITH {DONATIONS_SQL}, texts AS (SELECT DISTINCT lower(x) AS t FROM {_both}), seen AS (SELECT t, 0 AS o, t AS v FROM texts)"


def _preview(kind: str) -> str:
    return f"""array_to_string(list_transform(list_slice(list(value ORDER BY ord) FILTER (kind = '{kind}'), 1, 3), lambda v: '"' || v || '"'), ', ') AS {kind}_p"""


_counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}, {_preview(k)}" for k in KINDS)
_said = ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}, array_to_string(list_slice(list(phrase ORDER BY ord) FILTER (kind = '{k}'), 1, 3), ', ') AS {k}_p" for k in PHRASES)
EVIDENCE_SQL = f"""{HITS_SQL}, {PHRASES_SQL}, {BRANDS_SQL},
h AS (SELECT t, {_counts}, coalesce(sum(weight) FILTER (kind = 'hard'), 0) AS hard_w, coalesce(sum(weight) FILTER (kind = 'promo'), 0) AS promo_w,
  (list(id ORDER BY ord) FILTER (kind = 'promo'))[1] AS promo_1, (list(id ORDER BY ord) FILTER (kind = 'weak'))[1] AS weak_1, bool_or(id = 'judol-chain') AS chain FROM hits GROUP BY t),
p AS (SELECT t, {_said} FROM said GROUP BY t),
b AS (SELECT t, count(*) AS high, array_to_string(list_slice(list(brand ORDER BY ord), 1, 3), ', ') AS high_p FROM named GROUP BY t),
n AS (SELECT t, count(*) AS near, array_to_string(list_slice(list(brand ORDER BY ord), 1, 3), ', ') AS near_p FROM near_named GROUP BY t),
ev AS (SELECT texts.t, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*KINDS, *PHRASES, 'high', 'near', 'hard_w', 'promo_w'))}, coalesce(chain, false) AS chain, promo_1, weak_1,
  {', '.join(f'{c}_p' for c in (*KINDS, *PHRASES, 'high', 'near'))} FROM texts LEFT JOIN h USING (t) LEFT JOIN p USING (t) LEFT JOIN b USING (t) LEFT JOIN n USING (t))"""
_names = (*KINDS, *PHRASES, "high", "near", "hard_w", "promo_w")
_override = ", ".join(map(quoted, fixed.GAMING_OVERRIDE_IDS))


def decided_sql(gambling: str = "NULL::DOUBLE", texts: str = PLAIN_TEXTS, key: str = "lower(d.{})") -> str:
    """CTEs that end in decided(donation_id, ts, platform, donator, message, score, action, stage, reason).

    texts are the CTEs up to seen, key is what of a donation's field equals their t.
    """
    boost = f"coalesce(floor(({gambling} - 0.5) * {2 * fixed.CLASSIFIER_RANGE} + 0.5)::INTEGER, 0)"
    joined = f"""j AS (SELECT d.*, {', '.join(f'coalesce(m.{c}, 0) AS m_{c}' for c in _names)}, {', '.join(f'coalesce(o.{c}, 0) AS o_{c}' for c in ('hard', 'suspicious', 'high', 'near'))},
  m.promo_1, m.weak_1, coalesce(o.chain, false) AS o_chain, {', '.join(f'm.{c}_p AS m_{c}_p' for c in (*KINDS, *PHRASES, 'high', 'near'))}, {', '.join(f'o.{c}_p AS o_{c}_p' for c in ('hard', 'suspicious', 'high', 'near'))},
  (trim(coalesce(donator, '')) = '' AND trim(coalesce(message, '')) = '') AS blank, {gambling} AS g FROM donations d LEFT JOIN ev m ON {key.format("message")} = m.t LEFT JOIN ev o ON {key.format("donator")} = o.t)"""
    score = f"""s AS (SELECT *, CASE WHEN blank THEN 0 ELSE 5 * least(m_high, 2) + m_hard_w + m_promo_w + least(m_weak, 3) + 2 * least(o_high, 1) + least(o_suspicious, 2) + least(m_suspicious, 2)
  - CASE WHEN m_hard > 0 THEN 0 ELSE CASE WHEN m_gaming > 0 AND m_weak = 1 AND weak_1 = 'weak-slot' THEN 3 ELSE 0 END + CASE WHEN m_general > 0 AND m_promo = 0 AND m_high = 0 THEN 2 ELSE 0 END
  + CASE WHEN m_denounce > 0 AND m_promo = 0 AND m_high = 0 THEN 5 ELSE 0 END END + {boost} END::INTEGER AS score FROM j)"""
    stage = f"""c AS (SELECT *, CASE WHEN m_denounce > 0 AND m_hard = 0 AND m_promo = 0 AND m_high = 0 THEN 'allow/anti-judol-context' WHEN m_hard > 0 THEN 'block/hard-message' WHEN o_hard > 0 THEN 'block/hard-donor'
  WHEN m_high > 0 THEN 'block/message-brand' WHEN m_near > 0 THEN 'block/message-near-brand' WHEN o_high > 0 THEN 'block/donor-brand' WHEN o_near > 0 THEN 'block/donor-near-brand' WHEN o_chain THEN 'block/donor-judol-chain'
  WHEN m_promo >= 2 THEN 'block/two-promo' WHEN m_promo = 1 AND promo_1 IN ({_override}) AND m_gaming > 0 THEN 'allow/gaming-context-override' WHEN m_promo >= 1 THEN 'review/single-promo'
  WHEN score >= 9 AND (m_high > 0)::INT + (m_promo > 0)::INT + (m_weak >= 2)::INT + (m_suspicious > 0)::INT >= 2 THEN 'block/score-threshold'
  WHEN score >= 5 AND (o_high > 0 OR o_suspicious > 0 OR m_weak > 0) THEN 'review/review-threshold' ELSE 'allow/default' END AS v FROM s)"""
    lifted = f"e AS (SELECT *, CASE WHEN blank THEN 'allow/empty' WHEN g >= {fixed.CLASSIFIER_BLOCK} AND v NOT LIKE 'block/%' AND m_denounce = 0 THEN 'block/classifier-confident' ELSE v END AS w FROM c)"
    shown = (("hard", "m_hard"), ("donorHard", "o_hard"), ("promo", "m_promo"), ("msgBrands", "m_high"), ("msgNearBrands", "m_near"), ("donorBrands", "o_high"), ("donorNearBrands", "o_near"), ("donorSuspicious", "o_suspicious"), ("denounced", "m_denounce"), ("gamingSafe", "m_gaming"), ("generalSafe", "m_general"), ("strongGaming", "m_strong"))
    parts = ", ".join(f"CASE WHEN {c} > 0 THEN '{n}=' || {c}_p END" for n, c in shown)
    reason = f"""CASE WHEN blank THEN 'empty input' ELSE concat_ws('; ', 'score=' || score, 'classifier=' || printf('%.4f', g), CASE WHEN g IS NOT NULL AND {boost} <> 0 THEN 'classifierBoost=' || CASE WHEN {boost} > 0 THEN '+' ELSE '' END || {boost} END, {parts}) END"""
    return f"{texts}, {EVIDENCE_SQL}, {joined}, {score}, {stage}, {lifted}, decided AS (SELECT donation_id, ts, platform, donator, message, amount, score, split_part(w, '/', 1) AS action, split_part(w, '/', 2) AS stage, {reason} AS reason FROM e)"
