"""Rule patterns in the dialects of the engines that run them."""

from __future__ import annotations

import re

#: White space as message senders' browsers see it.
WHITE = r"\s   -     　﻿"
SPACE = f"[{WHITE}]"
#: A border between an ASCII word character and anything else; Java's own \b also counts other letters as word.
BORDER = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for Spark: borders on ASCII words, all white space, `$` only at the very end."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\b" and not inside:
            out.append(BORDER)
        elif two == r"\s":
            out.append(WHITE if inside else SPACE)
        elif two[0] == "\\":
            out.append(two)
        elif two[0] == "$" and not inside:
            out.append(r"\z")
            at -= 1
        else:
            inside = {"[": True, "]": False}.get(two[0], inside)
            out.append(two[0])
            at -= 1
        at += 2
    return ("(?i)" if ignore_case else "") + "".join(out)


def re2(pattern: str) -> str:
    """The pattern for RE2 over lower-cased text. Rules with look-ahead have no such form."""
    if "(?!" in pattern:
        raise ValueError("RE2 has no look-ahead")
    return pattern.replace(r"[\s\S]", r"(?s:.)").replace(r"\/", "/").replace(r"[\s\W]", r"[^A-Za-z0-9_]")


def has_re2(pattern: str) -> bool:
    return "(?!" not in pattern


def phrase(text: str) -> str:
    """A phrase as a pattern: borders where the phrase begins and ends, or the ends of the text."""
    return rf"(?:^|\b){re.escape(text)}(?:\b|$)"
