"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans are what exact patterns and checks give. Looser patterns propose more candidates, and so do matches of the exact
patterns that fail their checks: without them nearly every candidate would be personal, and no labeler could be told from another. Regex,
gazetteer, context, shape, checksum and border labelers vote yes, no or nothing on every candidate of the corpus.
Expectation-maximisation over the counts of vote patterns estimates each labeler's reliability per kind, and its
posteriors train a logistic span classifier. Candidates that it accepts are added to the base spans.

Only counts of vote cells (bounded by kinds * votes, not by the corpus) leave the executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import byte_slices, frugal, lean, text_slices

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "gazetteer", "context", "shape", "checksum", "border")
YES, NO, NONE = 1, 0, 2
LENGTHS = 3


class Span(NamedTuple):
    start: int
    end: int
    kind: int


DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match cannot begin inside a run of digits: from its first digit the same text follows.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
EXACT = (None, IP, CARD, PHONE)
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NOT_DIGIT = re.compile(r"[^0-9]+")
_AT = r"[(\[](?:at|AT)[)\]]"
AT = re.compile(_AT)
# What every base or loose span holds: a digit, an @, a written-out at, or (IPv6 of letters only) a group between colons.
HINT = re.compile(rf"[@0-9]|{_AT}|:[A-Fa-f]{{1,4}}:")

LOOSE_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?" + _AT + r" ?[A-Za-z0-9-]{1,63}(?: ?[(\[](?:dot|DOT)[)\]] ?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,5}")
LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])")
LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}(?:([ ./-])[0-9]{4,6})(?:\1[0-9]{3,5}){1,3}(?![0-9A-Za-z])")
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z.+(-])\(?0[0-9]{1,4}\)?[ ./-]?[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,4}(?![0-9A-Za-z-]|\.[0-9])")

LOOSE_RUN = re.compile(r"(?<![0-9A-Za-z.+_-])[0-9]{9,12}(?![0-9A-Za-z_-]|\.[0-9])")
#: Digits of matches that are offered although they fail: cards from a checksum or a digit off, phones that are too short or too long.
FAILED_CARD, FAILED_PHONE = range(13, 20), range(7, 18)

#: Words before a span that speak for its kind, against any kind, and gazetteers of prefixes and endings.
FOR = tuple(re.compile(rf"\b(?:{words})\b[^\n]{{0,12}}\Z", re.I) for words in ("e-?mail|mail|contact|write to|courriel|correo", "ip|host|server|address|adresse", "card|visa|mastercard|amex|credit|karte|carte|tarjeta", "tel|telephone|phone|mobile|call|fax|cell|telefon|téléphone|teléfono"))
AGAINST = re.compile(r"(?:\b(?:order|invoice|isbn|issn|version|page|item|ref|article|section|no|nr)\b|[$€£#§])[^\n]{0,4}\Z", re.I)
ENDINGS = frozenset("com net org edu gov int info io de fr es uk it nl eu ch at be us ca".split())
CARD_PREFIXES = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "30", "36", "38")
PRIVATE_NETS = ("10.", "127.", "192.168.", "fe80", "::")


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value = 2 * value - 9 * (value > 4)
        total += value
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    # Each match holds one @ after its local part: from every @ look left, then right. Linear in the text.
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (found := DOMAIN.match(text, at + 1)):
            yield Span(start, found.end(), 0)
            free = found.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Spans of the exact patterns and checks, by start, then kind as listed."""
    found = list(_emails(text)) if "@" in text else []
    found += [span for span, good in _checked(text) if good]
    return sorted(found, key=lambda s: (s.start, s.kind))


def _checked(text: str) -> Iterator[tuple[Span, bool]]:
    """Every match of the exact patterns but emails, and whether it passes its check."""
    for m in IP.finditer(text):
        yield Span(m.start(), m.end(), 1), all(int(part.lstrip("0")[:4] or 0) <= 255 for part in m[0].split("."))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        yield Span(m.start(), m.end(), 2), 14 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text) if "+" in text else ():
        yield Span(m.start(), m.end(), 3), 10 <= len(NOT_DIGIT.sub("", m[0])) <= 15


def failed_spans(text: str) -> list[Span]:
    """Matches of the exact patterns that fail their checks by little."""
    found = []
    for span, good in _checked(text):
        digits = 0 if good or span.kind == 1 else len(NOT_DIGIT.sub("", text[span.start : span.end]))
        if not good and (span.kind == 1 or digits in (FAILED_CARD if span.kind == 2 else FAILED_PHONE)):
            found.append(span)
    return found


def loose_spans(text: str) -> list[Span]:
    """Candidates of the looser patterns, and matches of the exact ones that fail."""
    found = failed_spans(text)
    for kind, pattern in ((0, LOOSE_EMAIL), (1, LOOSE_IP), (2, LOOSE_CARD), (3, LOOSE_PHONE), (3, LOOSE_RUN)):
        if kind or AT.search(text):
            found += [Span(m.start(), m.end(), kind) for m in pattern.finditer(text)]
    return found


def votes(text: str, span: Span, strict: bool) -> tuple[int, ...]:
    """What each labeler says of a candidate."""
    start, end, kind = span
    own, before = text[start:end], text[max(0, start - 40) : start]
    digits = NOT_DIGIT.sub("", own)
    regex_says = YES if strict else NO if kind and EXACT[kind].fullmatch(own) else NONE
    if kind == 0:
        gazetteer = YES if re.split(r"[.\])\s]+", own.rstrip(".-"))[-1].lower() in ENDINGS else NO
        shape = YES if not re.search(r"\.\.|^\.|--", own) else NO
        checksum = NONE
    elif kind == 1:
        gazetteer = YES if own.startswith(PRIVATE_NETS) else NONE
        shape = YES if not re.search(r"(?:^|\.)0[0-9]", own) else NO
        parts = own.split(".") if ":" not in own else []
        checksum = NO if len(set(digits)) == 1 or any(len(p) > 9 or int(p) > 255 for p in parts) else YES if parts else NONE
    elif kind == 2:
        gazetteer = YES if digits.startswith(CARD_PREFIXES) else NO
        shape = YES if len({c for c in own if not c.isdigit()}) < 2 and len(digits) in (14, 15, 16, 19) else NO
        checksum = YES if luhn(digits) else NO
    else:
        gazetteer = YES if own[0] == "+" and own[1] != "0" else NONE if own.lstrip("(")[0] == "0" else NO
        shape = YES if 9 <= len(digits) <= 15 and own.count("(") == own.count(")") else NO
        checksum = NO if len(set(digits)) < 4 else NONE
    context = NO if AGAINST.search(before) else YES if FOR[kind].search(before) else NONE
    near = text[start - 1 : start] + text[end : end + 1]
    border = NO if any(c.isalnum() or c in "/\\=_%" for c in near) else YES
    return regex_says, gazetteer, context, shape, checksum, border


def cell_of(text: str, span: Span, strict: bool) -> tuple[int, ...]:
    """Kind, votes and length class: what a candidate is to the models."""
    size = span.end - span.start
    return (span.kind, *votes(text, span, strict), 0 if size < 12 else 1 if size < 20 else 2)


def candidates(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and loose spans that touch none of them or of each other (leftmost, then longest)."""
    if not HINT.search(text):
        return [], []
    base = base_spans(text)
    # One sweep: loose spans come by start, base spans as disjoint stretches, and of the loose ones taken only the last matters.
    stretches: list[list[int]] = []
    for span in base:
        if stretches and span.start < stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], span.end)
        else:
            stretches.append([span.start, span.end])
    free, end, at = [], 0, 0
    for span in sorted(loose_spans(text), key=lambda s: (s.start, -s.end, s.kind)):
        while at < len(stretches) and stretches[at][1] <= span.start:
            at += 1
        if span.start >= end and (at == len(stretches) or span.end <= stretches[at][0]):
            free.append(span)
            end = span.end
    return base, free


class SpanModel(NamedTuple):
    """Logistic weights over one-hot cells, and the reliabilities that EM found."""

    weights: np.ndarray
    reliability: dict[str, dict[str, float]]
    threshold: float

    def accepts(self, cell: tuple[int, ...]) -> bool:
        return bool(float(_one_hot(np.array([cell]))[0] @ self.weights) >= np.log(self.threshold / (1 - self.threshold)))


def _one_hot(cells: np.ndarray) -> np.ndarray:
    """Per kind: a constant, two columns per labeler (yes, no) and the length classes."""
    n, votes_of = len(cells), cells[:, 1 : 1 + len(LABELERS)]
    plain = np.concatenate([np.ones((n, 1)), votes_of == YES, votes_of == NO, cells[:, -1:] == np.arange(LENGTHS)], 1)
    out = np.zeros((n, len(KINDS), plain.shape[1]))
    out[np.arange(n), cells[:, 0]] = plain
    return out.reshape(n, -1)


def expectation_maximisation(cells: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, dict]:
    """Posterior of 'personal' per cell, and P(yes vote | personal or not) per kind and labeler.

    Binary Dawid-Skene model with abstention, one per kind; smoothed counts, started from the vote balance.
    """
    posterior, found = np.zeros(len(cells)), {}
    for kind, name in enumerate(KINDS):
        own = np.flatnonzero(cells[:, 0] == kind)
        if not len(own):
            continue
        said, weight = cells[own, 1 : 1 + len(LABELERS)], counts[own].astype(float)
        balance = (said == YES).sum(1) - (said == NO).sum(1) + (said[:, 0] == YES)
        p = 1 / (1 + np.exp(-1.5 * (balance - 1.5)))
        for _ in range(rounds):
            prior = (weight @ p + 1) / (weight.sum() + 2)
            logit = np.full(len(own), np.log(prior / (1 - prior)))
            rates = []
            for labeler in range(len(LABELERS)):
                hit = np.stack([said[:, labeler] == v for v in (NO, YES)], 1).astype(float)  # abstaining says nothing
                yes, no = (weight * p) @ hit + [0.5, 1.5], (weight * (1 - p)) @ hit + [1.5, 0.5]
                rates.append((yes / yes.sum(), no / no.sum()))
                logit += hit @ (np.log(yes / yes.sum()) - np.log(no / no.sum()))
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        posterior[own] = p
        found[name] = {label: {"yes_if_personal": float(a[1]), "yes_if_not": float(b[1])} for label, (a, b) in zip(LABELERS, rates, strict=True)}
    return posterior, found


def fit(cells: Counter, threshold: float = 0.9, steps: int = 40, ridge: float = 0.1) -> SpanModel:
    """EM over counted cells, then logistic regression (Newton steps) on its posteriors."""
    width = _one_hot(np.zeros((1, 2 + len(LABELERS)), int)).shape[1]
    if not cells:
        return SpanModel(np.full(width, -1.0), {}, threshold)
    keys = np.array(sorted(cells))
    counts = np.array([cells[tuple(map(int, k))] for k in keys])
    target, reliability = expectation_maximisation(keys, counts)
    x, w = _one_hot(keys), np.log1p(counts)
    beta = np.zeros(width)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (target - p)) - ridge * beta
        curve = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(width)
        beta = beta + np.linalg.solve(curve, gradient)
    return SpanModel(beta, reliability, threshold)


def count_cells(docs: DataFrame, column: str = "text") -> Counter:
    """Counts of the vote cells of all candidates of all texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, _, texts in text_slices(batch.column(0)):
                for text in texts:
                    base, free = candidates(text)
                    seen.update(cell_of(text, s, True) for s in base)
                    seen.update(cell_of(text, s, False) for s in free)
        yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, k)) for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["cell", "n"])

    counted = docs.select(F.col(column).alias("_text")).mapInArrow(frugal(work), "cell string, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return Counter({tuple(map(int, r["cell"])): r["n"] for r in counted.collect()})


def all_spans(text: str, model: SpanModel, known: dict) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans (base and accepted ones) by start, then kind."""
    base, free = candidates(text)
    added = []
    for span in free:
        cell = cell_of(text, span, False)
        if cell not in known:
            known[cell] = model.accepts(cell)
        if known[cell]:
            added.append(span)
    return base, sorted([*base, *added], key=lambda s: (s.start, s.kind))


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",), model: SpanModel | None = None, mask: bool = False) -> DataFrame:
    """The kept columns, `base` and `spans` (arrays of kind, start, end in code points) and, with mask, `masked`.

    The model is fitted on all of docs unless one is given. Null and empty texts have no spans; a masked null
    stays null. Repeated rows stay, each with its spans. Other columns may have any name.
    """
    docs = lean(docs)
    model = model or fit(count_cells(docs, column))

    def listed(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[s.kind], "start": s.start, "end": s.end} for s in spans]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for first, last, _, _ in byte_slices(batch.column(len(keep))):
                part = batch.slice(first, last - first)
                texts = part.column(len(keep)).to_pylist()
                found = [all_spans(t, model, known) if t else ([], []) for t in texts]
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array([listed(b) for b, _ in found], SPANS), pa.array([listed(s) for _, s in found], SPANS)]
                if mask:
                    columns.append(pa.array([t and masked(t, s) for t, (_, s) in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, "base", "spans", *["masked"] * mask])

    source = docs.select(*keep, F.col(column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(frugal(work), f"{schema}, base {spans}, spans {spans}" + ", masked string" * mask)
