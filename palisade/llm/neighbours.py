"""Nearest neighbours by a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample; every vector is indexed in its leaf. A query walks the tree with a
priority queue of branches ordered by a bound on their cosine, and visits leaves in that order. How many
vectors it must see is calibrated against brute force on the sample: the visits are widened until
the wanted recall is reached, then spread by a margin. Candidates are compared by exact cosines.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import frugal, literal_rows, settled

#: Vectors that the tree is fitted on, at most; children of a node; sample vectors below which a node is a leaf.
FIT_ROWS, BRANCHES, LEAF_ROWS = 20_000, 8, 48
#: Sample queries of the calibration, recall they must reach, and by how much their visits are widened.
TRIALS, RECALL, MARGIN = 256, 0.95, 1.1
#: Index rows of a block: neighbouring leaves share one, a leaf with more rows is split over several.
BLOCK_ROWS = 4_096
#: Queries that meet a block in one task, about.
QUERY_ROWS = 2_048
#: Lists of up to so many (block, part) pairs are broadcast; longer ones are joined by shuffle.
BROADCAST_PAIRS = 500_000


class Tree(NamedTuple):
    """Nodes in order; node 0 is the root. A node has children first[i] .. first[i] + count[i] - 1, or is a leaf."""

    centres: np.ndarray
    first: np.ndarray
    count: np.ndarray
    radius: np.ndarray

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.count == 0)


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True, initial=0)
    vectors = vectors / np.where(scale > 0, scale, 1)
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def tamed(vectors: np.ndarray) -> np.ndarray:
    """Each vector by a power of two, so that its largest component is about 1: cosines stay exactly the same, and squares
    neither overflow nor vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True, initial=0))[1])


def k_means(rows: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Assignment of unit rows to at most k clusters by cosine (k-means++ start)."""
    chosen = [int(rng.integers(len(rows)))]
    gap = 1 - rows @ rows[chosen[0]]
    while len(chosen) < k and gap.max() > 1e-9:
        weight = np.maximum(gap, 0)
        chosen.append(int(rng.choice(len(rows), p=weight / weight.sum())))
        gap = np.minimum(gap, 1 - rows @ rows[chosen[-1]])
    centres = rows[chosen]
    for _ in range(rounds):
        owner = (rows @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, rows)
        kept = np.bincount(owner, minlength=len(centres)) > 0
        centres = unit(sums[kept])
    return (rows @ centres.T).argmax(1)


def grow(sample: np.ndarray, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> Tree:
    """The tree of a sample of vectors; rows that cannot be told apart stay in one leaf."""
    rng = np.random.default_rng(seed)
    rows = unit(sample.astype(float))
    centres, first, count, radius, todo = [], [], [], [], [np.arange(len(rows))]
    while todo:
        level, todo = todo, []
        begin = len(centres) + len(level)
        for own in level:
            centre = unit(rows[own].sum(0, keepdims=True))[0] if len(own) else np.zeros(rows.shape[1])
            centres.append(centre)
            angles = np.arccos(np.clip(rows[own] @ centre, -1, 1)) if len(own) else np.zeros(1)
            radius.append(float(np.quantile(angles, 0.95)))
            parts = []
            if len(own) > leaf_rows:
                owner = k_means(rows[own], branches, rng)
                parts = [own[owner == c] for c in range(owner.max() + 1)]
                parts = [p for p in parts if len(p)]
            if len(parts) < 2:
                parts = []
            first.append(begin + len(todo))
            count.append(len(parts))
            todo += parts
    return Tree(np.array(centres), np.array(first), np.array(count), np.array(radius))


def leaf_of(rows: np.ndarray, tree: Tree) -> np.ndarray:
    """Leaf of each unit row, from the root to the nearest child."""
    at = np.zeros(len(rows), np.int64)
    while True:
        inner = np.flatnonzero(tree.count[at] > 0)
        if not len(inner):
            return at
        for node in np.unique(at[inner]):
            own = inner[at[inner] == node]
            children = np.arange(tree.first[node], tree.first[node] + tree.count[node])
            at[own] = children[(rows[own] @ tree.centres[children].T).argmax(1)]


def best_bins(query: np.ndarray, tree: Tree) -> Iterator[int]:
    """Leaves, most promising first: a priority queue holds branches by the least angle they may reach."""
    heap = [(0.0, 0.0, 0)]
    while heap:
        _, _, node = heapq.heappop(heap)
        if not tree.count[node]:
            yield node
            continue
        children = np.arange(tree.first[node], tree.first[node] + tree.count[node])
        angles = np.arccos(np.clip(tree.centres[children] @ query, -1, 1))
        for child, angle in zip(children.tolist(), angles.tolist(), strict=True):
            heapq.heappush(heap, (max(0.0, angle - tree.radius[child]), angle, child))


def calibrate(sample: np.ndarray, tree: Tree, k: int, recall: float = RECALL, trials: int = TRIALS, margin: float = MARGIN) -> float:
    """Share of all vectors that the visited leaves must hold for the wanted recall on the sample."""
    rows = unit(sample.astype(float))
    if len(rows) <= k + 1:
        return 1.0
    leaf = leaf_of(rows, tree)
    sizes = np.bincount(leaf, minlength=len(tree.count))
    needed = []
    for own in range(0, len(rows), max(1, len(rows) // trials)):
        cosines = rows @ rows[own]
        cosines[own] = -2
        wanted = set(leaf[np.argpartition(-cosines, k)[:k]].tolist())
        want = np.bincount(leaf[np.argpartition(-cosines, k)[:k]], minlength=len(sizes))
        seen = 0
        for node in best_bins(rows[own], tree):
            seen += sizes[node]
            if want[node]:
                needed += [seen / len(rows)] * int(want[node])
                wanted.discard(node)
                if not wanted:
                    break
    return float(min(1.0, np.quantile(needed, recall) * margin))


def visits(query: np.ndarray, tree: Tree, sizes: np.ndarray, share: float, k: int) -> list[int]:
    """Leaves to search: until they hold the share of all vectors, and more than k of them."""
    out, seen, total = [], 0, int(sizes.sum())
    for node in best_bins(query, tree):
        if sizes[node]:
            out.append(node)
            seen += int(sizes[node])
            if seen >= share * total and seen > k + 1:
                break
    return out


def blocks_of(tree: Tree, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per leaf: its first block, and over how many blocks its rows are dealt. Leaves come in the tree's order."""
    start, parts = np.zeros(len(sizes), np.int64), np.ones(len(sizes), np.int64)
    block, held, todo = 0, 0, [0]
    while todo:
        node = todo.pop()
        if tree.count[node]:
            todo += range(tree.first[node] + tree.count[node] - 1, tree.first[node] - 1, -1)
            continue
        parts[node] = max(1, -(-sizes[node] // BLOCK_ROWS))
        if held and held + sizes[node] > BLOCK_ROWS:
            block, held = block + 1, 0
        start[node] = block
        if parts[node] > 1:
            block, held = block + int(parts[node]), 0
        else:
            held += int(sizes[node])
    return start, parts


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = np.array((column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten(), float)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", column: str = "embedding", fit_rows: int = FIT_ROWS) -> DataFrame:
    """query_id, rank (from 1), id, score: the k nearest found of each query row among all other rows.

    Rows with a null id or an unusable vector take no part. Vectors of different lengths have no cosine: each length is
    searched for itself. Ties go to the smaller id. A row is not its own candidate: rows of the query's id are left out,
    also when an id is repeated; repeated queries are answered once for each length. Fewer than k candidates give fewer
    rows; an empty table gives none.
    """
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"), is_query.alias("q")).where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = [r["width"] for r in rows.select(F.size("v").alias("width")).distinct().collect()]
    found = [_search(rows.where(F.size("v") == width), k, fit_rows) for width in sorted(widths)]
    if not found:
        schema = "query_id long, rank int, id long, score double"
        return vectors.sparkSession.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in schema.split(", "))])
    return reduce(DataFrame.unionByName, found)


def _search(rows: DataFrame, k: int, fit_rows: int) -> DataFrame:
    """search for vectors v of one length."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").select("v").limit(fit_rows).toArrow()
    base = _matrix(sample.column("v"))
    tree = grow(base)
    share = calibrate(base, tree, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_048):
                part = batch.slice(at, 2_048)
                leaf = leaf_of(unit(_matrix(part.column(1))), tree)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf.astype(np.int32))], ["id", "v", "q", "leaf"])

    placed = settled(rows.mapInArrow(frugal(assign), "id long, v array<double>, q boolean, leaf int"))
    # One count per leaf: bounded by the sample, not by the table.
    counted = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    sizes = np.zeros(len(tree.count), np.int64)
    for leaf, n in counted.items():
        sizes[leaf] = n
    start, blocks = blocks_of(tree, sizes)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                take, block, wanted = [], [], []
                for row, query in enumerate(unit(_matrix(part.column(1)))):
                    lists: dict[int, list[int]] = {}
                    for node in visits(query, tree, sizes, share, k):
                        for turn in range(blocks[node]):
                            lists.setdefault(int(start[node]) + turn, []).append(node)
                    take += [row] * len(lists)
                    block += lists
                    wanted += lists.values()
                rows_of = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows_of), part.column(1).take(rows_of), pa.array(block, pa.int32()), pa.array(wanted, pa.list_(pa.int32()))], ["id", "v", "block", "leaves"])

    asked = placed.where("q").select("id", "v").dropDuplicates(["id"])
    # A block's queries are dealt over parts; a block goes to those parts only that ask for it.
    parts = max(1, -(-placed.where("q").count() // QUERY_ROWS))
    asked = asked.mapInArrow(frugal(walk), "id long, v array<double>, block int, leaves array<int>")
    asked = asked.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts)).cast("int"))
    asked = settled(asked)
    places = literal_rows(spark, [{"leaf": int(n), "start": int(start[n]), "parts": int(blocks[n])} for n in tree.leaves], "leaf int, start int, parts int")
    stored = placed.select("id", "v", "leaf").join(F.broadcast(places), "leaf")
    stored = stored.select("id", "v", "leaf", (F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("block"))
    met = settled(asked.select(F.col("block").alias("_block"), F.col("part").alias("_part")).distinct())
    stored = stored.join(F.broadcast(met) if met.count() <= BROADCAST_PAIRS else met, F.col("block") == F.col("_block"))

    def compare(queries: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if queries.num_rows and index.num_rows:
            order = np.argsort(np.array(index.column("id")), kind="stable")
            ids, own = np.array(index.column("id"))[order], tamed(_matrix(index.column("v")))[order]
            norms, leaf = np.linalg.norm(own, axis=1), np.array(index.column("leaf"))[order]
            asked_ids, asked_rows, wanted = np.array(queries.column("id")), tamed(_matrix(queries.column("v"))), queries.column("leaves").to_pylist()
            for i, query in enumerate(asked_rows):
                cosines = (own @ query) / (norms * np.linalg.norm(query))
                cosines[(ids == asked_ids[i]) | ~np.isin(leaf, wanted[i])] = -np.inf
                near = _near(cosines, k)
                near, exact = _closest(near, _scores(own[near], query), ids, k)
                out += [(int(asked_ids[i]), int(ids[j]), float(score)) for j, score in zip(near, exact, strict=True)]
        names = ("query_id", "id", "score")
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=names)

    found = asked.groupBy("block", "part").cogroup(stored.select("id", "v", "leaf", "_block", "_part").groupBy("_block", "_part")).applyInArrow(compare, "query_id long, id long, score double")
    best = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("minus"), "id"))), 1, k)
    ranked = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("pos", "b"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.id").alias("id"), (-F.col("b.minus")).alias("score"))


def _near(cosines: np.ndarray, k: int) -> np.ndarray:
    """Indexes of all that may be among the k largest, given that sums made in another order differ in their last digits."""
    least = np.partition(cosines, len(cosines) - k)[len(cosines) - k] if len(cosines) > k else -np.inf
    return np.flatnonzero((cosines > -np.inf) & (cosines >= least - 1e-9))


def _scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines that depend on the numbers alone, not on where a row lies: sums are exact and rounded once. Equal rows are taken once."""
    distinct, of = np.unique(rows, axis=0, return_inverse=True)
    size = math.sqrt(math.fsum(query * query))
    made = [math.fsum(row * query) / (math.sqrt(math.fsum(row * row)) * size) for row in distinct]
    return np.array(made)[of.reshape(-1)] if len(rows) else np.zeros(0)


def _closest(near: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k of largest score, ties to smaller ids, and their scores."""
    best = np.lexsort((ids[near], -scores))[:k]
    return near[best], scores[best]
