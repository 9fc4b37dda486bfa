"""Rules, phrases, brands and near brands against the variants of a text.

Each matcher is a column function over arrays; the tables are small literals, so nothing is joined and nothing
shuffles. The relational forms at the end are for rule tables that users bring as data frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.functions.patterns import java, phrase

#: Parts between which no rule can match that does not match in one of them, but for gaps; only used to rule out.
JOINT = "\n\u0001\n"


def rule_hits(found: Column, rules: tuple) -> Column:
    """array<struct<id, value, weight>>: each rule's first match in the first variant that has one, in rule order."""
    joint = F.array_join(found, JOINT)
    hits = []
    for name, pattern, weight in rules:
        own = java(pattern)
        value = F.get(F.filter(F.transform(found, _extract(own)), lambda x: x != ""), F.lit(0))
        hit = F.struct(F.lit(name).alias("id"), value.alias("value"), F.lit(weight).alias("weight"))
        # One search over all variants at once rules most rules out; anchored ones are tried on each variant.
        hits.append(F.when(joint.rlike(own), hit) if not pattern.startswith("^") else hit)
    return F.filter(F.array(*hits), lambda h: h["value"].isNotNull())


def _extract(pattern: str):
    return lambda v: F.regexp_extract(v, pattern, 0)


def phrase_hits(found: Column, phrases: tuple[str, ...]) -> Column:
    """Phrases that stand in some variant, in phrase order."""
    joint = F.array_join(found, JOINT)
    return F.filter(F.array(*[F.when(joint.rlike(java(phrase(p))), F.lit(p)) for p in phrases]), lambda p: p.isNotNull())


def brand_hits(tokens: Column, squeezed: Column, brands: tuple[str, ...] = fixed.BRANDS, least: int = fixed.BRAND_SUBSTRING_MIN) -> Column:
    """Brands that are a token, or of at least `least` letters inside a squeezed variant, in brand order."""
    every = F.array(*map(F.lit, brands))
    return F.filter(every, lambda b: F.array_contains(tokens, b) | ((F.length(b) >= least) & F.exists(squeezed, lambda s: F.contains(s, b))))


def near_brand_hits(tokens: Column, squeezed: Column, exact: Column, brands: tuple[str, ...] = fixed.BRANDS, least: int = fixed.NEAR_BRAND_MIN, most: int = fixed.NEAR_BRAND_DISTANCE) -> Column:
    """Long brands within an edit distance of a token or squeezed variant, but not found exactly."""
    long = F.array(*[F.lit(b) for b in brands if len(b) >= least])
    forms = F.filter(F.array_union(tokens, squeezed), lambda t: F.length(t) >= least)

    def near(b: Column) -> Column:
        return F.exists(forms, lambda t: (t != b) & F.length(t).between(F.length(b) - most, F.length(b) + most) & (F.levenshtein(t, b, most) >= 0))

    return F.filter(long, lambda b: ~F.array_contains(exact, b) & near(b))


def weight_sum(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda total, h: total + h["weight"])


def previewed(hits: Column, most: int = 3) -> Column:
    return F.array_join(F.slice(F.transform(hits, lambda h: F.concat(F.lit('"'), h["value"], F.lit('"'))), 1, most), ", ")


def listed(values: Column, most: int = 3) -> Column:
    return F.array_join(F.slice(values, 1, most), ", ")


def join_tokens(texts: DataFrame, terms: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """(key, term) of terms (one column `term`) among each row's tokens: an equi join, distinct per row."""
    exploded = texts.select(key, F.explode(tokens).alias("term")).distinct()
    return exploded.join(terms.select("term").distinct(), "term", "left_semi").select(key, "term")
