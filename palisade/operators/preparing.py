"""Variants of many texts in Arrow batches, remembered per distinct text.

The same variants as palisade.functions.text.variants builds with column expressions; those grow with every reading, fold
and form, and are evaluated row by row, so the decision plan uses this form.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import fixed_values as fixed
from palisade.operators.evidence import REMEMBERED
from palisade.operators.typo import _matcher, tightened

_FOLDS = tuple(str.maketrans(*fold) for fold in (fixed.LEET_I, fixed.LEET_L, fixed.LEET_KEEP_468))
_BRANDS, _STEMS = frozenset(fixed.BRANDS), frozenset(fixed.STEMS)
_BETWEEN_LETTERS = re.compile(r"(?<=[A-Za-z])[01345678](?=[A-Za-z])")
_MARKS = str.maketrans("@$!|", "asii")
_DIGITS = str.maketrans("01345678", "oieasgtb")
_GAP = re.compile(r"\b([a-z]{2,8})\s+(\d{2,4})\b", re.A | re.I)
_ROUND = re.compile(r"[1-9]0+\Z")


#: Without such a character a text is its own fold, and without a digit no gap closes.
_FOLDED = re.compile("[" + re.escape("".join(fold[0] for fold in (fixed.LEET_I, fixed.LEET_L, fixed.LEET_KEEP_468)) + "@$!|01345678") + "]")
_DIGIT = re.compile("[0-9]")
_APART = re.compile("[^a-zA-Z0-9]+")


def _smart(text: str) -> str:
    # Neighbours are those of the text as it was: look-around sees the input, not what was folded before.
    return _BETWEEN_LETTERS.sub(lambda m: m[0].translate(_DIGITS), text).translate(_MARKS)


def _closed(text: str) -> str:
    def joined(m: re.Match) -> str:
        word = (m[1] + m[2]).lower()
        return word if word in _BRANDS or (m[1].lower() in _STEMS and not _ROUND.match(m[2])) else m[0]

    return _GAP.sub(joined, text)


def _forms(texts: list[str]) -> dict[str, None]:
    out: dict[str, None] = {}
    for text in dict.fromkeys(texts):
        for form in (text, tightened(text), _APART.sub(" ", text).strip()):
            if form:
                out[form] = None
    return out


@lru_cache(REMEMBERED)
def variants_of(bases: tuple[str, ...], words: tuple[str, ...] | None, fuzzy: bool) -> list[str]:
    """Ordered distinct variants of a text's readings."""
    bases = tuple(b for b in bases if b)
    seeds = [x for b in bases for x in ((b, *(b.translate(f) for f in _FOLDS), _smart(b)) if _FOLDED.search(b) else (b,))]
    if words is not None:
        seeds += [_matcher(words, fuzzy).canonical(b) for b in bases]
    found = _forms(seeds)
    found.update(_forms([c for v in list(found) if _DIGIT.search(v) and (c := _closed(v)) != v]))
    return list(found)


def variants(bases: Column, words: tuple[str, ...] | None, fuzzy: bool) -> Column:
    """array<string> of readings -> array<string> of variants; words is the dictionary, None for no typo step.

    A function of a batch and not of all batches: Spark then runs it and palisade.operators.evidence.evidence over it in one worker process.
    """

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([variants_of(tuple(b) if b is not None else (), words, fuzzy) for b in batch], dtype="object")

    return run(bases)
