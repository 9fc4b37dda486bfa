import random

import pytest

from palisade.llm import repeats

L = 50


def brute(rows, width=L):
    """Flagged words of each row by comparing all windows of all distinct (id, text) rows in order."""
    rows = sorted({(d if d is not None else repeats.LAST, t or "") for d, t in rows})
    first, places = {}, {}
    order = sorted(rows, key=lambda r: (r[0], r[1]))
    for doc, text in order:
        own = text.split()
        for i in range(len(own) - width + 1):
            places.setdefault(tuple(own[i : i + width]), []).append((doc, text, i))
    flagged: dict = {}
    for found in places.values():
        if len(found) > 1:
            for doc, text, i in found:
                flagged.setdefault((doc, text), set()).update(range(i, i + width))
    del first
    return flagged


def rows_of(seed=2):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (50, 51, 60, 75, 130, 49, 48)]
    rows = []
    for doc in range(70):
        parts = text(rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            parts += rng.choice(passages) + text(rng.randint(0, 60))
        rows.append((doc, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, "one two " * 60), (103, None), (104, ""), (105, "short")]
    return rows


@pytest.mark.parametrize("hot, compared, listed", [(100_000, 20_000, 4_000_000), (2, 9, 0), (12, 1, 0)])
def test_flagged_words_equal_brute_force(spark, monkeypatch, hot, compared, listed):
    monkeypatch.setattr(repeats, "HOT_PLACES", hot)
    monkeypatch.setattr(repeats, "COMPARED", compared)
    monkeypatch.setattr(repeats, "BROADCAST_TEXTS", listed)
    rows = rows_of()
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as first_id", "3 as _h")
    got: dict = {}
    kept = set()
    texts = dict(rows)
    for r in repeats.repeated_passages(frame).collect():
        got.setdefault((r.doc_id, texts[r.doc_id]), set()).update(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word >= L
        if r.kept:
            kept.add((r.doc_id, r.start_word))
    want = brute(rows)
    assert got == want
    assert kept


def test_after_cutting_nothing_repeats(spark):
    rows = rows_of(9)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as source")
    cut = repeats.cut_repeats(frame)
    assert cut.columns == ["doc_id", "text", "source"]
    after = [(r.doc_id, r.text) for r in cut.collect()]
    assert len(after) == len(rows)
    before = brute(rows)
    for doc, text in after:
        if (doc, dict(rows)[doc] or "") not in before:
            assert text == dict(rows)[doc]
    words_before = {w for _, t in rows for w in (t or "").split()}
    assert {w for _, t in after for w in (t or "").split()} == words_before
    left = sum(len((t or "").split()) for _, t in after)
    assert left < sum(len((t or "").split()) for _, t in rows)


def test_null_ids_repeated_rows_and_empty(spark):
    text = " ".join(map(str, range(60)))
    rows = [(None, text), (1, text), (1, text), (2, "é " + text)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.start_word, r.end_word, r.kept, r.first_doc_id) for r in repeats.repeated_passages(frame).collect())
    assert ("1", 0, 60, True, 1) in got and ("2", 1, 61, False, 1) in got and ("None", 0, 60, False, 1) in got
    assert repeats.repeated_passages(frame.limit(0)).count() == 0
    assert repeats.cut_repeats(frame.limit(0)).count() == 0


def first_places(rows, width):
    """(doc, start word) of every passage -> the first place with the same words."""
    first, out = {}, {}
    for doc, text in sorted({(d, t) for d, t in rows}):
        own = text.split()
        for i in range(len(own) - width + 1):
            out[doc, i] = first.setdefault(tuple(own[i : i + width]), (doc, i))
    return out


@pytest.mark.parametrize("hot", [100_000, 3])
@pytest.mark.parametrize("width", [12, 50])
def test_first_place_stays_and_extensions_end_at_the_word(spark, monkeypatch, hot, width):
    """Few words, so that cores are shared by passages that differ on either side; rows repeated whole."""
    monkeypatch.setattr(repeats, "HOT_PLACES", hot)
    rng = random.Random(width)
    line = [str(rng.randrange(10**6)) for _ in range(140)]
    rows = []
    for doc in range(40):
        a, b = sorted(rng.sample(range(141), 2))
        rows.append((doc, " ".join([f"a{doc}", *line[a:b], f"b{doc}", *(line[b:a + 70] if rng.random() < 0.5 else [])])))
    rows += [rows[7]] * 5 + [(90, rows[7][1])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    firsts, got = first_places(rows, width), {}
    found = repeats.repeated_passages(frame, width).collect()
    assert len({tuple(r.asDict().values()) for r in found}) == len(found)
    for r in found:
        for i in range(r.start_word, r.end_word - width + 1):
            got.setdefault((r.doc_id, i), set()).add((r.kept, r.first_doc_id))
    counts: dict = {}
    for place in firsts.values():
        counts[place] = counts.get(place, 0) + 1
    for place, first in firsts.items():
        if place[0] == 90:
            # A copy repeats the first document of its text as a whole.
            assert got[place] == {(False, 7)}
        elif counts[first] > 1:
            assert (place == first, first[0]) in got[place], place
        else:
            assert place not in got


def test_very_long_texts(spark):
    rng = random.Random(1)
    passage = " ".join(str(rng.randrange(10**9)) for _ in range(60))
    long = " ".join("v%d" % rng.randrange(10**9) for _ in range(250_000))
    rows = [(1, long + " " + passage), (2, passage + " tail")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.kept) for r in repeats.repeated_passages(frame).collect())
    assert got == [(1, 250_000, 250_060, True), (2, 0, 60, False)]
    assert {r.doc_id: len(r.text) for r in repeats.cut_repeats(frame).collect()} == {1: len(rows[0][1]), 2: 4}
