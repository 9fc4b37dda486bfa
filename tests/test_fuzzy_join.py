"""Deletion keys and the ladder by joins against plain comparison with every word."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.operators import typo


def worn(rng, word, edits):
    letters = list(word)
    for _ in range(edits):
        at = rng.randrange(len(letters) + 1)
        letters[at : at + rng.randrange(2)] = rng.choice([[], ["e"], ["x"]])
    return "".join(letters)


def plain(token, words, same_first):
    most = 0 if len(token) < 5 else 1 if len(token) < 7 else 2
    best = []
    for place, word in enumerate(words if most else ()):
        distance = typo.bounded_distance(token, word, most)
        if distance is not None and (not same_first or token[:1] == word[:1]):
            shared = next((i for i, (x, y) in enumerate(zip(token, word)) if x != y), min(len(token), len(word)))
            best.append((distance, -shared, -len(word), place, word))
    return (min(best)[4], min(best)[0]) if best else None


@pytest.mark.parametrize("same_first", [True, False])
def test_nearest_words(spark, same_first):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("aeinst") for _ in range(rng.choice([2, 4, 5, 6, 7, 8, 12]))) for _ in range(700)} | {"a"})
    tokens = [worn(rng, rng.choice(words), rng.randrange(4)) for _ in range(600)] + ["", "q" * 5_000, "aaaaa", None]
    w = spark.createDataFrame(list(enumerate(words)), "ord int, word string")
    got = {r.token: (r.match, r.distance) for r in typo.fuzzy_join(spark.createDataFrame([(t,) for t in tokens], "token string"), w, same_first).collect()}
    want = {t: found for t in tokens if t and (found := plain(t, words, same_first))}
    assert got == want and len(got) > 250
    assert typo.fuzzy_join(w.select(F.col("word").alias("token")), w.limit(0), same_first).count() == 0


def test_texts_within_two_edits_share_a_key(spark):
    rng = random.Random(4)
    pairs = [(word, worn(rng, word, rng.randrange(3))) for word in ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(400))]
    frame = spark.createDataFrame(pairs, "a string, b string")
    keys = [typo.deletion_keys(F.col(c), F.lit(2), False) for c in "ab"]
    for row in frame.select("a", "b", F.arrays_overlap(*keys).alias("met"), F.levenshtein("a", "b").alias("d")).collect():
        assert row.met or row.d > 2


def test_the_ladder_by_joins_equals_the_batch_form(spark):
    rng = random.Random(7)
    stems = [*typo.EVERYDAY[:60], "gacor", "maxwin", "togel"]
    tokens = [worn(rng, rng.choice(stems), rng.randrange(3)) for _ in range(250)]
    tokens += ["G4C0R", "p4st1", "!!kata!!", "k-a-t-a", "123", "", " ", None, "k@mu", "s3rv3r"]
    frame = spark.createDataFrame([(t,) for t in tokens], "token string").distinct()
    words = spark.createDataFrame(list(enumerate(typo.EVERYDAY)), "ord int, word string")
    for fuzzy in (True, False):
        batch = {r.token: tuple(r)[1:] for r in typo.match_tokens(frame, "token", fuzzy=fuzzy).collect()}
        joined = {r.token: tuple(r)[1:] for r in typo.ladder_join(frame, words, fuzzy=fuzzy).collect()}
        assert joined == batch and len({v[0] for v in joined.values()}) >= 5 - (not fuzzy)


def test_keys_are_those_of_plain_deletion():
    def left(word, most, kept):
        out = {word}
        for _ in range(most):
            out |= {w[:i] + w[i + 1 :] for w in out for i in range(kept, len(w))}
        return out

    def key(word):
        return typo._key_lists([word], np.array([0]), 0).to_pylist()[0][0]

    rng, every = random.Random(5), set()
    words = ["".join(rng.choices("ab\0é\U0001F600", k=rng.randrange(9))) for _ in range(300)] + ["", None, "c" * 40]
    for kept in (0, 1):
        most = np.array([rng.randrange(-1, 3) for _ in words])
        for word, edits, keys in zip(words, most, typo._key_lists(words, most, kept).to_pylist(), strict=True):
            own = None if word is None or edits < 0 else left(word, edits, kept)
            assert (own and sorted(map(key, own))) == (keys and sorted(keys))
            every |= own or set()
    assert len(set(map(key, every))) == len(every) > 500


@pytest.mark.parametrize("held", [3, 200_000])
def test_counts_of_words(spark, monkeypatch, held):
    monkeypatch.setattr(typo, "WORDS_HELD", held)
    texts = ["Kata kataékata, KATA-b", "Kata İni x1y", "", None, "a" * 5_000 + " Z\0z q", "[kata]^_`{a}@"]
    got = {r["word"]: r["count"] for r in typo.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == Counter(w.lower() for t in texts for w in re.findall("[A-Za-z]+", t or ""))


def test_documents_are_read_once_for_rare_and_usual_words(spark):
    from palisade.plans import catalogue

    made = catalogue.QUERIES["fuzzy_documents"](spark, "/root/testdata/sf0.001")
    made._jdf.collect()
    final = str(made._jdf.queryExecution().executedPlan()).split("Initial Plan")[0]
    assert final.count("FileScan") == final.count("MapInArrow") == 1 and final.count("ReusedExchange") == 2


def test_pairs_are_joined_by_their_key_alone(spark):
    """With the first letter as another key all rows of a letter would be sorted by it first."""
    words = spark.createDataFrame([(0, "warung")], "ord int, word string")
    plan = str(typo.fuzzy_join(words.select(F.col("word").alias("token")), words.hint("merge"), True)._jdf.queryExecution().executedPlan())
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert len(joins) == 1 and re.search(r"Join \[key#\d+L\], \[key#\d+L\]", joins[0]), joins
