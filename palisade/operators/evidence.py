"""All evidence of one text's variants in one pass over Arrow batches.

The column functions of palisade.operators.matching give the same hits one list at a time. A decision needs ten lists,
whose expressions together outgrow what the JVM compiles; here each distinct text is matched once per worker and
remembered. One pass of an automaton over all variants names the few rules and phrases that are worth trying, one over
squeezed variants finds the brands inside them, and one over long forms the brands that an edit or two may lead to.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.functions.patterns import phrase
from palisade.operators.literals import Gate, needed_literals
from palisade.operators.matching import JOINT
from palisade.operators.typo import bounded_distance
from palisade.sources.events import small_batches

#: Texts whose evidence a worker remembers.
REMEMBERED = 50_000
RULES = {"hard": fixed.HARD_RULES, "suspicious": fixed.SUSPICIOUS_RULES, "promo": fixed.PROMO_RULES, "weak": fixed.WEAK_RULES}
PHRASES = {"anti": fixed.ANTI_PHRASES, "gaming": fixed.GAMING_PHRASES, "general": fixed.GENERAL_PHRASES, "strong": fixed.STRONG_GAMING_PHRASES}
DONOR_LISTS = ("high", "near", "hard", "suspicious")
MESSAGE_LISTS = (*DONOR_LISTS, "promo", "weak", *PHRASES)
HIT = "array<struct<id:string,value:string,weight:int>>"
#: White space as senders' browsers see it is what Python's own class holds, but word borders are ASCII ones.
_ASCII = re.ASCII | re.IGNORECASE
_TOKEN, _APART = re.compile("[a-z0-9]+"), re.compile("[^a-zA-Z0-9]+")


@lru_cache(1)
def _compiled() -> tuple[list, list, Gate]:
    """(list, id, pattern, weight) of all rules, (list, phrase, pattern) of all phrases, and the gate over both, rules first."""
    rules = [(kind, name, re.compile(p.replace("$", r"\Z"), _ASCII), w) for kind, rows in RULES.items() for name, p, w in rows]
    phrases = [(kind, p, re.compile(phrase(p), _ASCII)) for kind, rows in PHRASES.items() for p in rows]
    return rules, phrases, Gate([*(needed_literals(r[2].pattern) for r in rules), *(frozenset({p[1]}) for p in phrases)])


@lru_cache(1)
def _brands() -> tuple[dict[str, int], Gate, Gate]:
    """Place of each brand; the gate of brands that count inside squeezed text; the gate of near brands.

    A near form of a brand that is cut into one part more than edits are allowed holds one of the parts as it is.
    """
    parts = fixed.NEAR_BRAND_DISTANCE + 1
    cut = [frozenset(b[len(b) * i // parts : len(b) * (i + 1) // parts] for i in range(parts)) if len(b) >= fixed.NEAR_BRAND_MIN else frozenset() for b in fixed.BRANDS]
    inside = [frozenset({b} if len(b) >= fixed.BRAND_SUBSTRING_MIN else ()) for b in fixed.BRANDS]
    return {b: i for i, b in enumerate(fixed.BRANDS)}, Gate(inside), Gate(cut)


def brands_of(tokens: Iterable[str], squeezed: Iterable[str]) -> list[str]:
    """Brands that are a token, or long enough and inside a squeezed text, in brand order."""
    place, inside, _ = _brands()
    found = {place[t] for t in tokens if t in place}
    for text in squeezed:
        found |= inside.found(text)
    return [fixed.BRANDS[i] for i in sorted(found)]


def _near(forms: list[str], exact: list[str]) -> list[str]:
    most, found, near = fixed.NEAR_BRAND_DISTANCE, set(), _brands()[2]
    for form in forms:
        if len(form) >= fixed.NEAR_BRAND_MIN:
            for place in near.found(form) - found:
                brand = fixed.BRANDS[place]
                if form != brand and bounded_distance(form, brand, most) is not None:
                    found.add(place)
    return [brand for brand in map(fixed.BRANDS.__getitem__, sorted(found)) if brand not in exact]


@lru_cache(REMEMBERED)
def evidence_of(variants: tuple[str, ...], message: bool) -> dict:
    """Hit lists of a text: brands, near brands and rules; for messages also promo and weak rules and phrases."""
    rules, phrases, gate = _compiled()
    joint = JOINT.join(variants)
    tokens = list(dict.fromkeys(t for v in variants for t in _TOKEN.findall(v)))
    squeezed = list(dict.fromkeys(s for v in variants if (s := _APART.sub("", v).lower())))
    high = brands_of(tokens, squeezed)
    out: dict = {"high": high, "near": _near(list(dict.fromkeys([*tokens, *squeezed])), high)}
    wanted = (*RULES, *PHRASES) if message else ("hard", "suspicious")
    out |= {name: [] for name in wanted}
    for number in sorted(gate.worth(joint)):
        kind, name, pattern, *weight = rules[number] if number < len(rules) else phrases[number - len(rules)]
        if kind not in out:
            continue
        # A match of the joint text may lie over a border of variants, and an anchored one needs a variant's own ends.
        found = next((m for m in map(pattern.search, variants) if m), None) if weight else pattern.search(joint)
        if found:
            out[kind].append({"id": name, "value": found[0], "weight": weight[0]} if weight else name)
    return out


def evidence(variants: Column, message: bool) -> Column:
    """array<string> -> struct of the hit lists."""
    names = MESSAGE_LISTS if message else DONOR_LISTS
    schema = "struct<" + ",".join(f"{n}:{HIT if n in RULES else 'array<string>'}" for n in names) + ">"

    @F.pandas_udf(schema)
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([evidence_of(tuple(v) if v is not None else (), message) for v in batch], columns=list(names))

    return run(variants)


@lru_cache(1)
def _phrase_table() -> tuple[list, Gate]:
    phrases = _compiled()[1]
    return phrases, Gate(frozenset({p[1]}) for p in phrases)


@lru_cache(REMEMBERED)
def phrases_of(variants: tuple[str, ...]) -> dict:
    """The phrases that stand in a text, by list."""
    phrases, gate = _phrase_table()
    joint, out = JOINT.join(variants), {name: [] for name in PHRASES}
    for number in sorted(gate.worth(joint)):
        kind, name, pattern = phrases[number]
        if pattern.search(joint):
            out[kind].append(name)
    return out


def phrase_lists(variants: Column) -> Column:
    """array<string> -> struct of the phrases of each list: phrase_hits of palisade.operators.matching by one pass over the text."""

    @F.pandas_udf("struct<" + ",".join(f"{name}:array<string>" for name in PHRASES) + ">")
    def run(batch: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([phrases_of(tuple(v) if v is not None else ()) for v in batch], columns=list(PHRASES))

    return run(variants)


@lru_cache(REMEMBERED)
def _both_brands(tokens: tuple[str, ...], squeezed: tuple[str, ...]) -> tuple[list[str], list[str]]:
    high = brands_of(tokens, squeezed)
    return high, _near(list(dict.fromkeys([*tokens, *squeezed])), high)


def brand_lists(tokens: Column, squeezed: Column) -> Column:
    """array<string> twice -> struct<high, near>: brand_hits and near_brand_hits of palisade.operators.matching, in time linear in the text."""

    @F.pandas_udf("struct<high:array<string>,near:array<string>>")
    def run(some: pd.Series, joined: pd.Series) -> pd.DataFrame:
        rows = [_both_brands(tuple(t) if t is not None else (), tuple(s) if s is not None else ()) for t, s in zip(some, joined, strict=True)]
        return pd.DataFrame(rows, columns=["high", "near"])

    return run(tokens, squeezed)


def brands_by_text(texts: DataFrame, key: str, near: bool = False, tokens: str = "tokens", squeezed: str = "squeezed") -> DataFrame:
    """(key, brand), a row for each brand that a text has (near: that it nearly has). Nothing is joined; only hits become rows."""
    found = texts.select(key, brand_lists(F.col(tokens), F.col(squeezed)).alias("_b"))
    return found.select(key, F.explode("_b.near" if near else "_b.high").alias("brand"))


#: Rules of a table that every worker may hold.
MOST_RULES = 10_000


@lru_cache(4)
def _rule_table(rows: tuple[tuple[str, str, int], ...]) -> tuple[list, Gate]:
    return [re.compile(pattern, _ASCII) for _, pattern, _ in rows], Gate(needed_literals(pattern) for _, pattern, _ in rows)


def rules_by_text(texts: DataFrame, rules: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, id, weight) of the rules (id, pattern, weight) of a table that match texts, in no order.

    Patterns are read as the engine's own, in any case. The table is read once and must have MOST_RULES rows at most; texts stay where
    they are, and each is tried only against the rules that one pass of the gate names: there is no product of texts and rules.
    """
    rows = tuple((str(r["id"]), r["pattern"], int(r["weight"])) for r in rules.select("id", "pattern", "weight").orderBy("id").limit(MOST_RULES + 1).collect())
    if len(rows) > MOST_RULES:
        raise ValueError(f"a rule table of more than {MOST_RULES} rows is not held by every worker")

    @F.pandas_udf("array<struct<id:string,weight:int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        patterns, gate = _rule_table(rows)
        for batch in batches:
            found = [[n for n in sorted(gate.worth(t)) if patterns[n].search(t)] if t else [] for t in batch]
            yield pd.Series([[{"id": rows[n][0], "weight": rows[n][2]} for n in own] for own in found], dtype="object")

    return small_batches(texts).select(key, F.explode(run(F.col(text))).alias("_h")).select(key, "_h.id", "_h.weight")
