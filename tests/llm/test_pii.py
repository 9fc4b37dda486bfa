import re
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import pii

PLAIN = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {0: lambda: True, 1: lambda: all(int(p) <= 255 for p in m[0].split(".")), 2: lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), 3: lambda: 10 <= len(digits) <= 15}[kind]()
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a@.-%+ 01259()é\n", max_size=60))
def test_base_spans_equal_plain_patterns(text):
    assert [tuple(s) for s in pii.base_spans(text)] == plain_spans(text)


def test_known_spans_and_masking():
    text = "mail a.b@c.de, host 10.0.0.1 card 4111 1111 1111 1111 tel +1 (389) 555-5010."
    base, free = pii.candidates(text)
    assert [pii.KINDS[s.kind] for s in base] == ["email", "ip", "card", "phone"] and not free
    assert pii.masked(text, base) == "mail <EMAIL>, host <IP> card <CARD> tel <PHONE>."


def plain_failed(text):
    """Matches of the exact patterns that are no base spans, near enough to be offered."""
    base, out = set(plain_spans(text)), []
    for kind in (1, 2, 3):
        for m in re.finditer(PLAIN[kind], text):
            digits = len(re.sub("[^0-9]", "", m[0]))
            if (m.start(), m.end(), kind) not in base and (kind == 1 or digits in ((), (), range(13, 20), range(7, 18))[kind]):
                out.append((m.start(), m.end(), kind))
    return out


def plain_loose(text):
    patterns = ((0, pii.LOOSE_EMAIL), (1, pii.LOOSE_IP), (2, pii.LOOSE_CARD), (3, pii.LOOSE_PHONE), (3, pii.LOOSE_RUN))
    return plain_failed(text) + [(m.start(), m.end(), kind) for kind, pattern in patterns for m in pattern.finditer(text)]


PIECES = ["john", "ab", " ", ".", "(at)", "[at]", "(AT)", "[AT]", "(at]", "(dot)", "[DOT]", "com", ":", "fe:", "ab:CD:ef:aa:bb:cc:dd:ee", "12", "@", "é"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_candidates_leave_no_text_out(text):
    assert [tuple(s) for s in pii.loose_spans(text)] == plain_loose(text)
    base, free = pii.candidates(text)
    assert [tuple(s) for s in base] == plain_spans(text)
    for start, end, _ in plain_loose(text):
        assert any(start < s.end and s.start < end for s in [*base, *free])


NUMBERS = ["4111111111111112", "300.1.2.3", "+1 23 45 67", "0391555501", "123456789012345678901", "0391 555 5010", "(0391) 555-50-10", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.1.2.3", "+1 389 555 5010", "a@b.co", "bob (at) x (dot) com", " ", ", ", "x", "1:2:3:4:5:6:7:8"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(NUMBERS), max_size=12).map(" ".join))
def test_sweep_equals_looking_at_all_spans(text):
    base, free = pii.candidates(text)
    taken, want = [(s.start, s.end) for s in pii.base_spans(text)], []
    for span in sorted(pii.loose_spans(text), key=lambda s: (s.start, -s.end, s.kind)):
        if all(span.end <= a or span.start >= b for a, b in taken):
            want.append(span)
            taken.append((span.start, span.end))
    assert free == want and base == pii.base_spans(text)


def test_many_numbers_take_linear_time():
    text = "tel (0391) 555-50-10, " * 20_000
    began = time.perf_counter()
    assert len(pii.candidates(text)[1]) == 20_000
    assert time.perf_counter() - began < 5


def test_expectation_maximisation_equals_a_plain_walk():
    """The same model candidate by candidate, with every copy counted as often as it occurs."""
    rng = np.random.default_rng(3)
    cells = sorted({(1, *rng.integers(0, 3, 6).tolist(), 0) for _ in range(25)})
    counts = rng.integers(1, 40, len(cells))
    rows = [cell[1:7] for cell, n in zip(cells, counts.tolist()) for _ in range(n)]
    p = [1 / (1 + np.exp(-1.5 * (sum(v == 1 for v in r) - sum(v == 0 for v in r) + (r[0] == 1) - 1.5))) for r in rows]
    for _ in range(50):
        prior = (sum(p) + 1) / (len(rows) + 2)
        rates = []
        for labeler in range(6):
            yes, no = {0: 0.5, 1: 1.5}, {0: 1.5, 1: 0.5}
            for r, q in zip(rows, p):
                if r[labeler] != 2:
                    yes[r[labeler]] += q
                    no[r[labeler]] += 1 - q
            rates.append(({v: yes[v] / sum(yes.values()) for v in yes}, {v: no[v] / sum(no.values()) for v in no}))
        p = []
        for r in rows:
            good, bad = prior, 1 - prior
            for labeler, v in enumerate(r):
                if v != 2:
                    good, bad = good * rates[labeler][0][v], bad * rates[labeler][1][v]
            p.append(good / (good + bad))
    found, reliability = pii.expectation_maximisation(np.array(cells), counts)
    at = np.cumsum(counts) - counts
    assert np.abs(found - np.array(p)[at]).max() < 1e-9
    assert abs(reliability["ip"]["context"]["yes_if_personal"] - rates[2][0][1]) < 1e-9


def test_candidates_without_digits():
    for text, kind in [("write john (AT) example (DOT) com now", 0), ("john [AT] example.com", 0), ("john (at] example.com", 0), ("host ab:cd:ef:aa:bb:cc:dd:FE up", 1)]:
        base, free = pii.candidates(text)
        assert not base and [s.kind for s in free] == [kind], text


def test_votes_train_a_classifier_that_adds_spans():
    seen = pii.Counter()
    sure = ["mail a@b.com ", "tel +1 389 555 5010 ", "card 4111 1111 1111 1111 ", "server 10.1.2.3 "]
    loose = ["phone (0391) 555 50 10 end", "email bob (at) example (dot) com now"]
    noise = ["order 0391 555 50 10x", "invoice 0100-11-11-11/2"]
    for text in sure * 50 + loose * 10 + noise * 10:
        base, free = pii.candidates(text)
        seen.update(pii.cell_of(text, s, True) for s in base)
        seen.update(pii.cell_of(text, s, False) for s in free)
    model = pii.fit(seen)
    for text in loose:
        assert len(pii.all_spans(text, model, {})[1]) == 1, text
    assert pii.fit(pii.Counter()).accepts((0, 1, 1, 1, 1, 1, 1, 0)) is False


def test_failing_matches_are_the_contrast_that_em_learns_from():
    rng = np.random.default_rng(6)

    def number(valid):
        while True:
            digits = "4" + "".join(map(str, rng.integers(0, 10, 15)))
            if pii.luhn(digits) == valid:
                return digits

    seen = pii.Counter()
    texts = [f"pay with {number(True)} now" for _ in range(150)] + [f"serial {number(False)} of it" for _ in range(60)] + ["host 10.2.3.4 up"] * 80 + ["release 300.2.3.4 is out"] * 30
    for text in texts:
        base, free = pii.candidates(text)
        seen.update(pii.cell_of(text, s, True) for s in base)
        seen.update(pii.cell_of(text, s, False) for s in free)
    assert sum(n for cell, n in seen.items() if cell[1] == pii.NO) == 90
    model = pii.fit(seen)
    card = model.reliability["card"]
    assert card["checksum"]["yes_if_personal"] > 0.95 and card["checksum"]["yes_if_not"] < 0.1
    assert card["regex"]["yes_if_personal"] > 0.95 and card["regex"]["yes_if_not"] < 0.1
    assert not any(len(pii.all_spans(t, model, {})[1]) for t in texts if t.startswith(("serial", "release")))
    assert all(len(pii.all_spans(t, model, {})[1]) == 1 for t in texts if t.startswith(("pay", "host")))


def test_frames(spark):
    rows = [(1, "x a@b.co y"), (1, "x a@b.co y"), (None, None), (2, ""), (3, "é +1 (389) 555-5010")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as spans", "2 as base")
    out = {(r.doc_id, r.masked) for r in pii.find_pii(docs, mask=True).collect()}
    assert out == {(1, "x <EMAIL> y"), (None, None), (2, ""), (3, "é <PHONE>")}
    assert pii.find_pii(docs).count() == 5
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_added_spans_are_what_the_fitted_model_accepts(spark):
    texts = ["mail a@b.com tel +1 389 555 5010"] * 40 + ["phone (0391) 555 50 10 end", "email bob (at) example (dot) com now", "order 0391 555 50 10x", None, ""] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = pii.Counter()
    for text in texts:
        base, free = pii.candidates(text or "")
        seen.update(pii.cell_of(text, s, True) for s in base)
        seen.update(pii.cell_of(text, s, False) for s in free)
    assert pii.count_cells(docs) == seen
    model = pii.fit(seen)
    for r in pii.find_pii(docs).collect():
        text = texts[r.doc_id] or ""
        base, free = pii.candidates(text)
        want = sorted([*base, *(s for s in free if model.accepts(pii.cell_of(text, s, False)))], key=lambda s: (s.start, s.kind))
        assert [(s.kind, s.start, s.end) for s in r.spans] == [(pii.KINDS[s.kind], s.start, s.end) for s in want]


def test_very_long_texts(spark):
    text = "plain words and more " * 120_000 + "mail a@b.co end"
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: (len(r.base), r.masked[-15:]) for r in pii.find_pii(docs, mask=True).collect()}
    assert got == {1: (1, "ail <EMAIL> end"), 2: (0, "short")}
