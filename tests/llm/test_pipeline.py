"""The corpus pipeline on a small corpus, each stage against what it must keep, drop or change."""

import random

import pytest

import corpus_pipeline
from palisade.llm import quality_cnn

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, _id long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(4)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("n", "r", "st", "lly")]

    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))

    passage = text(70)
    rows, labels = [], []
    for i in range(260):
        good = i % 4 != 0
        body = text(rng.randint(20, 150))
        rows.append((i, body if good else body.replace(" ", "%%% ")))
        labels.append((i, int(good), 0))
    rows += [(300, rows[1][1]), (301, rows[2][1] + " extra"), (302, text(40) + " " + passage), (303, text(30) + " " + passage + " " + text(20)), (304, text(60) + " mail ann.lee@mail.example.com or +1 (389) 555-5010 now"), (305, None), (306, ""), (None, text(50)), (307, text(60_000))]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1.0, "x", 5) for d, t in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, passage


def test_stages_in_order(spark, corpus, tmp_path):
    folder, rows, passage = corpus
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns, name
            seen[i] = {r.doc_id: r for r in docs.collect()}
    texts = dict(rows)
    # Quality: exactly the rows that the network of the same fit keeps; clean rows are among them.
    raw = spark.read.parquet(f"{folder}/documents.parquet")
    net = quality_cnn.fit(raw, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = {r.doc_id: r.score for r in quality_cnn.score_quality(raw, net).collect()}
    assert set(seen[0]) == {d for d, s in scores.items() if s >= corpus_pipeline.LEAST_QUALITY}
    clean = [d for d, t in rows if t and "%%%" not in t]
    assert sum(d in seen[0] for d in clean) >= 0.97 * len(clean) and sum(d in seen[0] for d, t in rows if t and "%%%" in t) <= 5
    # Near duplicates: 300 equals 1, 301 nearly equals 2.
    if {1, 300} <= set(seen[0]):
        assert 1 in seen[1] and 300 not in seen[1]
    assert {302, 303, 304} & set(seen[0]) == {302, 303, 304} & set(seen[1])
    # Repeats: the passage stays in 302 only; every row stays.
    assert set(seen[2]) == set(seen[1])
    assert passage in seen[2][302].text and passage not in seen[2][303].text and seen[2][303].n_chars == len(seen[2][303].text)
    assert all(seen[2][d].text == texts[d] for d in seen[2] if d not in (303,))
    # Personal data.
    assert set(seen[3]) == set(seen[2]) and seen[3][304].text.endswith("mail <EMAIL> or <PHONE> now")
    assert all(seen[3][d].text == seen[2][d].text for d in seen[3] if d != 304)
    packed = docs.collect()
    # A very long text goes through whole.
    assert seen[3][307].text == texts[307]
    pieces = sorted((r.start, r.length) for r in packed if r.doc_id == 307)
    assert len(pieces) > 50 and [start for start, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))]
    assert {r.doc_id for r in packed} == set(seen[3]) and all(r.offset + r.length <= 1024 for r in packed)


def test_stages_on_empty_documents(spark, corpus):
    folder, _, _ = corpus
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
