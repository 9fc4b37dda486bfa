"""Nearest labelled examples against plain comparison with all of them."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import toxicity
from palisade.llm.toxicity import Examples, fit, fit_curve, score_toxicity, term_codes
from tests.llm.test_resampling import words

BAD = ["scum", "trash", "idiot", "réeuxa"]


def plain_terms(text):
    out = Counter()
    for word in words(text):
        body = word.encode()
        for width in range(3, 9):
            if len(body) >= width:
                out[body[:width]] += 1
            elif len(body) == width - 1:
                out[body + b" "] += 1
    return out


def made(rng, bad, n=60):
    stems = ["the", "of", "lore", "ñandú", "ab", "x", "scura", "traces", "日本語"]
    text = [rng.choice(stems) + rng.choice(["", "", "ing", "es", "ly"]) for _ in range(n)]
    for _ in range(rng.randrange(1, 4) if bad else 0):
        text.insert(rng.randrange(len(text)), rng.choice(BAD) + rng.choice(["", "s"]))
    return " ".join(text).replace("the", "The")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    rows = [(i, made(rng, i % 6 == 0, rng.choice([5, 60, 200]))) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows] + [(5, 0), (None, 1), (7, None), (100_000, 1)], "doc_id long, toxic int")
    return dict(rows), docs, labels, fit(docs, labels)


def test_scores_evidence_and_held_out_rows(corpus):
    texts, docs, _, judge = corpus
    known = {}
    for code, once, again in zip(judge.known.codes.tolist(), judge.known.once.tolist(), judge.known.again.tolist()):
        known[(code % (1 << 64)).to_bytes(8, "big").lstrip(b"\0")] = (once, again)
    assert {b"scum", b"idiot ", b"r\xc3\xa9eux"} <= set(known)

    def vector(text):
        out = {}
        for term, n in plain_terms(text).items():
            once, again = known.get(term, (-1, -1))
            if once >= 0:
                out[once] = (1 + math.log(n)) * judge.known.idf[once]
            if again >= 0 and n > 1:
                out[again] = (1 + math.log(n - 1)) * judge.known.idf[again]
        norm = math.sqrt(sum(v * v for v in out.values()))
        return {t: v / norm for t, v in out.items()}

    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 5 and vector(texts[i])]
    assert sorted(judge.examples.ids) == learned
    index = {i: vector(texts[i]) for i in learned}
    right = total = 0
    for row in score_toxicity(docs, judge).collect():
        own = vector(texts[row["doc_id"]])
        cosines = {i: sum(v * index[i].get(t, 0) for t, v in own.items()) for i in learned}
        best = sorted((i for i in learned if cosines[i] > 0), key=lambda i: (-round(cosines[i], 9), i))[:10]
        assert [round(e["cosine"], 9) for e in row["evidence"]] == [round(cosines[i], 9) for i in best]
        assert all(abs(cosines[e["doc_id"]] - e["cosine"]) < 1e-9 and e["label"] == int(e["doc_id"] % 6 == 0) for e in row["evidence"])
        if not zlib.crc32(str(row["doc_id"]).encode()) % 5:
            total += 1
            right += (row["score"] >= 0.5) == (row["doc_id"] % 6 == 0)
    assert total > 100 and right / total >= 0.98


def test_block_max_search_is_exact():
    rng = np.random.default_rng(4)
    for blocks in (1, 7):
        n, width = 60 * blocks + 3, 40
        terms = [np.sort(rng.choice(width, rng.integers(1, 6), replace=False)) for _ in range(n)]
        weights = [(lambda w: w / np.sqrt((w * w).sum()))(rng.integers(1, 4, len(t)).astype(float)) for t in terms]
        ids = rng.permutation(n).tolist()
        examples = Examples(ids, rng.integers(0, 2, n).tolist(), terms, weights, width)
        dense = np.zeros((n, width))
        for i, (t, w) in enumerate(zip(terms, weights)):
            dense[i, t] = w
        for i in range(0, n, 5):
            sums = dense @ dense[i]
            order = sorted((j for j in range(n) if sums[j] > 1e-12), key=lambda j: (-round(sums[j], 9), ids[j]))[:10]
            found, cosines = examples.nearest(terms[i], weights[i], 10)
            assert [examples.ids[e] for e in found] == [ids[j] for j in order]
            assert np.allclose(cosines, sums[order])
            left, _ = examples.nearest(terms[i], weights[i], 10, but=int(np.flatnonzero(np.array(examples.ids) == ids[i])[0]))
            assert ids[i] not in [examples.ids[e] for e in left]


def test_odd_texts_and_names(spark, corpus):
    _, _, _, judge = corpus
    rows = [(1, None, 7), (2, "", 7), (3, "?! .", 7), (4, "scum", 7), (4, "scum", 7), (None, "The idiot", 7), (5, "the of", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, evidence int").withColumnRenamed("evidence", "_text")
    got = score_toxicity(docs, judge).collect()
    scores = {}
    for r in got:
        scores.setdefault(r["doc_id"], []).append(r["score"])
    assert scores[1] == scores[2] == scores[3] == scores[5] == [judge.base] and judge.base < 0.1
    assert len(scores[4]) == 2 and scores[4][0] == scores[4][1] > 0.5 < scores[None][0] <= 1


def test_very_long_texts_come_in_pieces(spark, corpus, monkeypatch):
    _, _, _, judge = corpus
    monkeypatch.setattr(toxicity, "SLICE_BYTES", 1_000)
    text = "lore of " * 3_000
    docs = spark.createDataFrame([(1, text), (2, text + "scum " + text), (3, "w" * 100_000)], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] > 0.5 for r in score_toxicity(docs, judge).collect()} == {1: False, 2: True, 3: False}
    # The labelled sample is counted by text, not by piece.
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "doc_id long, label long")
    counted = {(r["code"] % (1 << 64)).to_bytes(8, "big").lstrip(b"\0"): (r["n"], r["bad"]) for r in toxicity._counted(docs.join(labels, "doc_id").select("label", "text")).where("not twice").collect()}
    assert counted[b"lore "] == (2, 1) and counted[b"scum "] == (1, 1)


def test_no_labels_no_rows(spark):
    docs = spark.createDataFrame([(1, "scum"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    judge = fit(docs, none)
    assert [r["score"] for r in score_toxicity(docs, judge).collect()] == [0.25, 0.25]
    assert score_toxicity(docs.limit(0), judge).collect() == []
    one_class = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r["score"] < 0.3 for r in score_toxicity(docs, fit(docs, one_class)).collect())


def test_terms_against_plain_ones():
    rng = random.Random(2)
    texts = [made(rng, i % 2 == 0, 20) for i in range(9)] + ["", "a", "Ab", "日"]
    joined = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    codes, of = term_codes(np.frombuffer(joined, np.uint8), offsets)
    for i, text in enumerate(texts):
        own = Counter((c % (1 << 64)).to_bytes(8, "big").lstrip(b"\0") for c in codes[of == i].tolist())
        assert own == plain_terms(text)


def test_the_curve_rises():
    rng = np.random.default_rng(1)
    votes = rng.random(400)
    curve = fit_curve(votes, (rng.random(400) < votes**2).astype(float))
    got = [curve.of(v) for v in np.linspace(0, 1, 50)]
    assert got == sorted(got) and 0 < got[0] < 0.2 and 0.8 < got[-1] < 1
