"""The salted donations reach every rule, phrase and stage that the queries claim to show."""

import re

from palisade.functions import fixed_values as fixed
from palisade.functions.patterns import phrase
from palisade.plans.salted import DONORS, MESSAGES


def test_every_rule_and_phrase_occurs():
    texts = [m.lower() for m in MESSAGES if m]
    for name, pattern, _ in (*fixed.HARD_RULES, *fixed.PROMO_RULES, *fixed.WEAK_RULES, *fixed.SUSPICIOUS_RULES):
        assert any(re.search(pattern, t, re.A) for t in texts), name
    for text in (*fixed.ANTI_PHRASES, *fixed.GAMING_PHRASES, *fixed.STRONG_GAMING_PHRASES, *fixed.GENERAL_PHRASES):
        assert any(re.search(phrase(text), t, re.A) for t in texts), text


def test_near_brands_occur_where_exact_ones_do_not():
    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    for texts in (MESSAGES, DONORS):
        forms = {t for m in texts if m for t in re.findall("[a-z0-9]+", m.lower()) if len(t) >= fixed.NEAR_BRAND_MIN}
        assert any(0 < apart(f, b) <= fixed.NEAR_BRAND_DISTANCE and b not in f for f in forms for b in fixed.BRANDS if len(b) >= fixed.NEAR_BRAND_MIN)
