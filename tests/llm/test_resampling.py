"""Importance resampling against plain Python over the same rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from palisade.llm import resampling
from palisade.llm.resampling import chunks_of, resample
from palisade.llm.word_runs import crc32_slices

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, target, percent=10, runs=1, buckets=10_000, least=20):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, runs + 1) for i in range(len(w) - n + 1)]

    own = [features(t) for _, t in docs]
    s = np.bincount([b for f in own for b in f], minlength=buckets)
    t = np.bincount([b for x in target for b in features(x)], minlength=buckets)
    gain = [math.floor(1000 * math.log((b + 1.0) * (s.sum() + buckets) / ((a + 1.0) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out = []
    for (doc_id, text), f in zip(docs, own):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([doc_id, len(words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, row in enumerate(fit[: len(fit) * percent // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=str)


def made(rng, n):
    alphabet = ["the", "The", "é", "of", "x1", "naïve", "z" * 70, "日本", "a", "B"]
    return " ".join(rng.choice(alphabet) + rng.choice(["", ",", "\n", "-", "_"]) for _ in range(n))


@pytest.mark.parametrize("runs", [1, 3])
def test_against_plain_python(spark, monkeypatch, runs):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", 200)
    rng = random.Random(runs)
    docs = [(i, made(rng, rng.choice([0, 5, 19, 20, 40, 300]))) for i in range(120)]
    long = made(rng, 400)
    docs += [(5, long), (5, long), (None, made(rng, 30)), (None, None), (900, None), (901, ""), (902, "!!! ..."), (7, made(rng, 50)), (903, "y" * 5_000)]
    target = [made(rng, 40), None, "the of the"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, weight string")
    got = resample(frame.repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent=40, runs=runs)
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, target, percent=40, runs=runs)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample(docs.limit(0), docs).collect() == []
    assert [r["rank"] for r in resample(docs, docs.limit(0), percent=100, least_words=1).collect()] == [1]


@pytest.mark.parametrize("carry", [0, 1, 4])
def test_chunks_own_each_start_once(carry):
    rng = random.Random(carry)
    for _ in range(50):
        text = made(rng, rng.randrange(80)).encode()
        parts = list(chunks_of(text, carry, 30))
        assert b"".join(body[:owned] for owned, body in parts) == text
        starts = 0
        for owned, body in parts:
            inside = [m for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", body)]
            own = [m for m in inside if m.start() < owned]
            assert all(m.end() <= owned for m in own)
            assert len(inside) - len(own) <= carry
            starts += len(own)
        assert starts == len(words(text.decode()))


def test_crc32_of_slices():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 5_000).astype(np.uint8)
    first = rng.integers(0, 4_000, 300)
    last = first + rng.choice([0, 1, 5, 47, 48, 49, 900], 300)
    assert [int(c) for c in crc32_slices(data, first, last)] == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(first, last)]
