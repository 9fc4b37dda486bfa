"""Which of many patterns are worth trying on a text: one pass over it for the literals that they cannot do without.

For every pattern a set of literals is read off its parse tree so that each match holds at least one of them. All
literals go into one Aho-Corasick automaton; its hits name the patterns to try. Patterns without such a set are always tried. The
gate never changes what matches, only what is searched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from re import _constants as op
from re import _parser

import ahocorasick

#: Strings that a part of a pattern may stand for, to be listed one by one.
MOST_STRINGS = 256

Strings = frozenset[str]


def _exact(items) -> Strings | None:
    """All strings that a sequence of a parse tree stands for, lower-cased; None where they are too many."""
    out = frozenset({""})
    for code, value in items:
        if code is op.LITERAL:
            found = frozenset({chr(value).lower()})
        elif code is op.AT or code in (op.ASSERT, op.ASSERT_NOT):
            continue  # takes up no text: leaving it out only lets more through
        elif code is op.SUBPATTERN:
            found = _exact(value[3])
        elif code is op.BRANCH:
            parts = [_exact(branch) for branch in value[1]]
            found = None if None in parts else frozenset().union(*parts)
        elif code is op.IN and all(kind is op.LITERAL for kind, _ in value):
            found = frozenset(chr(c).lower() for _, c in value)
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] == 1:
            once = _exact(value[2])
            found = once if value[0] == 1 or once is None else once | {""}
        else:
            found = None
        if found is None or len(out) * len(found) > MOST_STRINGS:
            return None
        out = frozenset(a + b for a in out for b in found)
    return out


def _worth(found: Strings | None) -> tuple[int, int]:
    """Sets of longer shortest strings are better, then smaller ones."""
    return (0, 0) if not found else (min(map(len, found)), -len(found))


def _needed(items) -> Strings | None:
    """The best set of strings of which every match of a sequence holds one; None where there is none."""
    best: Strings | None = None
    items = list(items)
    for first in range(len(items)):
        # The longest run from here that stands for few strings, then what single parts need within.
        for last in range(len(items), first, -1):
            run = _exact(items[first:last])
            if run is not None:
                best = max(best, None if "" in run else run, key=_worth)
                break
        code, value = items[first]
        inner = None
        if code is op.SUBPATTERN:
            inner = _needed(value[3])
        elif code is op.BRANCH:
            parts = [_needed(branch) for branch in value[1]]
            inner = None if None in parts else frozenset().union(*parts)
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] >= 1:
            inner = _needed(value[2])
        best = max(best, inner, key=_worth)
    return best if best and "" not in best else None


def needed_literals(pattern: str) -> Strings | None:
    """Lower-case literals of which every match of the pattern holds one, in any case; None if there are no such."""
    return _needed(_parser.parse(pattern, re.IGNORECASE))


class Gate:
    """Numbers of the patterns that may match a text."""

    def __init__(self, literals: Iterable[Strings | None]) -> None:
        by_literal: dict[str, set[int]] = {}
        self.always: set[int] = set()
        for number, own in enumerate(literals):
            if own is None:
                self.always.add(number)
            for literal in own or ():
                by_literal.setdefault(literal, set()).add(number)
        self.automaton = ahocorasick.Automaton()
        for literal, numbers in by_literal.items():
            self.automaton.add_word(literal, frozenset(numbers))
        if by_literal:
            self.automaton.make_automaton()
        self.empty = not by_literal

    def found(self, text: str) -> set[int]:
        """Numbers of patterns that have a literal in a lower-case text."""
        return set() if self.empty else set().union(*(numbers for _, numbers in self.automaton.iter(text)))

    def worth(self, text: str) -> set[int]:
        return self.always | self.found(text.lower())
