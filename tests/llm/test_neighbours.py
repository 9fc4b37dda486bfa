import numpy as np
from pyspark.sql import functions as F

from palisade.llm import neighbours


def brute(ids, rows, query, k):
    scores = rows @ rows[query] / (np.linalg.norm(rows, axis=1) * np.linalg.norm(rows[query]))
    order = [j for j in np.lexsort((ids, -scores)) if j != query][:k]
    return [(int(ids[j]), float(scores[j])) for j in order]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))
    ids = np.arange(1500)
    frame = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, rows)], "vec_id long, embedding array<float>")
    rows = rows.astype(np.float32).astype(float)
    found: dict = {}
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0, k=5).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    hits = 0
    assert sorted(found) == list(range(0, 1500, 50))
    for query, got in found.items():
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        want = brute(ids, rows, query, 5)
        hits += len({w[0] for w in want} & {g[1] for g in got})
        for _, vec, score in got:
            assert abs(score - rows[vec] @ rows[query] / np.linalg.norm(rows[vec]) / np.linalg.norm(rows[query])) < 1e-12
    assert hits / (5 * len(found)) >= 0.9


def test_ties_unusable_rows_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (3, [2.0, 0.0]), (1, [4.0, 0.0]), (50, [0.0, 1.0]), (7, None), (8, [nan, 1.0]), (9, [0.0, 0.0]), (10, [None, 1.0]), (11, [inf, 1.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("leaf", F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.id) for r in neighbours.search(frame, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 1), (0, 2, 3), (0, 3, 50), (50, 1, 0), (50, 2, 1), (50, 3, 3)]
    assert neighbours.search(frame.limit(0), F.lit(True)).count() == 0


def test_copies_tie_wherever_they_lie(spark, monkeypatch):
    rng = np.random.default_rng(12)
    for rows_of_block in (20_000, 16):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", rows_of_block)
        for n in (7, 10, 150):
            base = rng.normal(size=(n, 64))
            base[rng.permutation(n)[: n // 2]] = base[1]
            base[0] = base[1] + 0.1 * rng.normal(size=64)
            frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(base)], "vec_id long, embedding array<double>").repartition(3)
            got = sorted((r["rank"], r.id, r.score) for r in neighbours.search(frame, F.col("vec_id") == 0).collect())
            copies = [i for i in range(1, n) if (base[i] == base[1]).all()]
            assert [g[1] for g in got][: len(copies)] == copies[:5] and len({g[2] for g in got[: len(copies)]}) == 1


def test_hot_vector_and_leaf_split(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    rows = [(i, [1.0, 0.5]) for i in range(120)] + [(i, [float(i % 7), 1.0]) for i in range(120, 160)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in neighbours.search(frame, F.col("vec_id") == 50).collect()}
    assert [got[50, r] for r in range(1, 6)] == [0, 1, 2, 3, 4]


def test_isotropic_noise_reaches_the_recall(spark):
    rng = np.random.default_rng(9)
    rows = rng.normal(size=(3000, 64)).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in neighbours.search(frame, F.col("vec_id") % 50 == 0, k=5).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    hits = sum(len(got[q] & {i for i, _ in brute(np.arange(3000), rows, q, 5)}) for q in range(0, 3000, 50))
    assert hits / (5 * len(got)) >= 0.9


def test_extreme_sizes_and_lengths_of_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e-200, 0.0]), (2, [3e-320, 3e-320]), (3, [0.0, 5.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.5]), (6, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in neighbours.search(frame, F.col("vec_id").isin(0, 4, 6)).collect()}
    assert [got[0, r][0] for r in (1, 2, 3)] == [2, 1, 3] and (0, 4) not in got
    assert abs(got[0, 1][1] - 1) < 1e-12 and abs(got[0, 2][1] - 0.5**0.5) < 1e-12
    assert got[4, 1][0] == 5 and len(got) == 4


def test_queries_of_a_block_are_split(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = rng.normal(size=(400, 8))
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    whole = {tuple(r) for r in neighbours.search(frame, F.col("vec_id") % 5 == 0).collect()}
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 7)
    monkeypatch.setattr(neighbours, "BROADCAST_PAIRS", 0)
    assert {tuple(r) for r in neighbours.search(frame, F.col("vec_id") % 5 == 0).collect()} == whole and len(whole) == 400
