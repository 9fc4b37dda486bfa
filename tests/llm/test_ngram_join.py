import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palisade.llm import ngram_join
from palisade.llm.shingles import shingles


def plain_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, percent=80):
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                up[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i)) if sets[i] else doc, links[i]) for i, (doc, _) in enumerate(rows)), key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aA bé\n\t\x1c .", max_size=40), min_size=1, max_size=6))
def test_shingles_equal_plain_sets(texts):
    data = [t.encode() for t in texts]
    got = shingles(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    assert [len(g) for g in got] == [len(plain_set(t)) for t in texts]
    for a, x in zip(got, texts):
        for b, y in zip(got, texts):
            assert len(np.intersect1d(a, b)) == len(plain_set(x) & plain_set(y))


def family(rng, n, changes, vocabulary=400, size=60):
    base = [str(rng.randrange(vocabulary)) for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, changes)):
            own[rng.randrange(len(own))] = str(rng.randrange(vocabulary))
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("tile", [2048, 5])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram_join, "BLOCK_TILE", tile)
    monkeypatch.setattr(ngram_join, "GROUP_TILE", tile)
    rng = random.Random(5)
    texts = [t for _ in range(12) for t in family(rng, rng.randint(1, 14), 3)]
    line = " ".join(map(str, range(1000, 1012)))
    texts += [t + " " + line for t in family(rng, 30, 60)]
    texts += [None, "", " \n", "one two", "ONE  two", "one two three four five", texts[3], texts[3], texts[40].upper()]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts), (ids[0], texts[0]), (None, texts[5]), (None, "alone without an id")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h1", "2 as n", "3 as _id")
    got = sorted((tuple(r) for r in ngram_join.similar_documents(frame).collect()), key=str)
    assert got == brute(rows)


def test_large_runs_span_what_small_ones_do():
    rng = random.Random(12)
    sets = [ngram_join.shingles(*packed(t))[0] for _ in range(9) for t in family(rng, 12, 6)]
    run = [(0, i, len(s), ngram_join.sketch_of(s)) for i, s in enumerate(sets)]

    def groups(edges):
        root = list(range(len(run)))
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    whole = groups(ngram_join._many_survivors(run, 80))
    pairs = [(a, b) for a in range(len(run)) for b in range(a) if ngram_join.may_link(*[(run[i][2], 8 * len(run[i][3]), int.from_bytes(run[i][3], "little")) for i in (a, b)], 80)]
    assert whole == groups(pairs) and len(set(whole)) > 1 and len(run) > 64


def packed(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_keep_one_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, "x y z"), (None, None), (7, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as source")
    kept = sorted((r.doc_id is not None, r.doc_id, r.source) for r in ngram_join.keep_one(frame).collect())
    assert [k[1] for k in kept] == [None, 2, 7, 9]
    assert ngram_join.similar_documents(frame.limit(0)).count() == 0
    assert ngram_join.keep_one(frame.limit(0)).count() == 0


def test_keep_one_decides_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    copied, other = family(rng, 2, 0), [f"{i} lone text that is like none of the others {i}" for i in range(4)]
    rows = [(5, copied[0]), (None, copied[1]), (None, other[0]), (None, other[1]), (None, None), (None, None), (6, other[2]), (6, copied[0]), (8, other[3]), (8, other[3]), (8, "")]
    # Groups under null ids, under one id, and under ids that others share.
    for i, ids in enumerate([(None, None), (None, None, None), (11, 11), (11, None, 12), (12, 11), (13, None)]):
        texts = family(rng, 1, 0, 10_000 + i)
        rows += [(doc, texts[0] + " end" * (place % 2)) for place, doc in enumerate(ids)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "'s' as h1", "doc_id", "array(1, null) as n")
    kept = ngram_join.keep_one(frame)
    assert kept.columns == frame.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    sets, groups = [plain_set(t) for _, t in rows], []
    for at, own in enumerate(sets):
        near = [g for g in groups if own and any(100 * len(own & sets[i]) >= 80 * len(own | sets[i]) for i in g)]
        groups = [g for g in groups if g not in near] + [[at, *(i for g in near for i in g)]]
    assert len(got) == len(groups)
    for group in groups:
        members = [rows[i] for i in group]
        least = min((doc for doc, _ in members if doc is not None), default=None)
        alike = [g for g in got if g in members]
        assert alike and all(doc == least for doc, _ in alike), members


def test_very_long_texts(spark):
    long = [f"w{i}" for i in range(300_000)]
    rows = [(3, " ".join(long)), (1, " ".join([*long[:150_000], "other", *long[150_001:]])), (2, " ".join(long[:100_000])), (4, "a b c d e")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_join.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {3: (299_996, 1, 1), 1: (299_996, 1, 1), 2: (99_996, 2, 0), 4: (1, 4, 0)}
