"""Toxicity of whole texts by the nearest labelled examples, with the examples as evidence.

Terms are the beginnings of words, LEAST_BYTES to MOST_BYTES long, and whole words of that length with the space behind them, so that a stem
counts under any ending; a term that comes again in a text is a second term besides. Those whose presence depends on the label
(chi squared over the labelled sample) are the vocabulary; a text is the TF-IDF vector of these terms at length one. The k examples of largest cosine vote, near ones more; a
monotone curve, fitted to the votes that labelled examples get from the others, turns votes into probabilities.

Search is exact. Examples lie in blocks, the inverted index has for each term its postings by block and the largest weight of
each block. A text's terms bound what any example of a block can reach; blocks are scored from the highest bound on
until no bound reaches the k-th best. The index is made of a bounded sample and goes to tasks as a whole; all rows
are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import SLICE_BYTES, byte_slices, frugal, lean, settled
from palisade.llm.quality_cnn import held_out
from palisade.llm.resampling import chunks_of
from palisade.llm.word_runs import LOWER, WORD

#: Bytes of a term.
LEAST_BYTES, MOST_BYTES = 3, 8
SPACE = np.uint8(32)
#: Bytes of words, lower-cased; all others are spaces.
TIDY = np.where(WORD, LOWER, SPACE)
#: Labelled rows that the index is made of, at most; terms of the vocabulary, at most, and what a term must reach.
FIT_ROWS, TERMS, LEAST_CHI, LEAST_DOCS = 20_000, 2_048, 50.0, 4
#: Examples of a block; examples that vote.
BLOCK, NEAREST = 64, 10
#: Weight of a vote is 1 / (1 - cosine + SOFT).
SOFT = 0.05
#: Distinct terms that a task counts before it sends them on.
HELD_TERMS = 1 << 20


def term_codes(flat: np.ndarray, offsets: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(terms, their text) of all texts; a term is its bytes as one number. begins: marks of the first LEAST_BYTES bytes of words that matter."""
    tidy = TIDY[flat]
    solid = tidy != SPACE
    edge = np.diff(solid.view(np.int8), prepend=0)
    # A word also begins where a text does, and ends where a text ends.
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flat))]
    cut = inner[solid[inner] & solid[inner - 1]]
    begin = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
    end = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut, np.full(int(len(flat) > 0 and solid[-1]), len(flat))]))
    tidy = np.append(tidy, SPACE)
    length = end - begin
    code, codes, at = np.zeros(len(begin), np.uint64), [], []
    for width in range(1, MOST_BYTES + 1):
        # The space behind a word makes a term of the whole word.
        far = length >= width - 1
        if width == LEAST_BYTES and begins is not None:
            last = np.where(length == width - 1, SPACE, tidy[np.minimum(begin + width - 1, len(flat))])
            far &= begins[(code << np.uint64(8) | last).astype(np.int64)]
        code, begin, length = code[far], begin[far], length[far]
        code = code << np.uint64(8) | np.where(length == width - 1, SPACE, tidy[begin + width - 1])
        if width >= LEAST_BYTES:
            codes.append(code)
            at.append(begin)
    return np.concatenate(codes).view(np.int64), np.searchsorted(offsets, np.concatenate(at), "right") - 1


def term_counts(column: pa.Array, known: Vocabulary | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, their row, how often the row has them) for runs of rows, in order of row and code; no row is in two runs.

    With a vocabulary only its codes are counted, by their places in it. A long text is counted in pieces cut between words.
    """
    begins = None if known is None else known.begins()
    for first, _, flat, offsets in byte_slices(column):
        pieces = [(flat, offsets)] if len(flat) <= 2 * SLICE_BYTES else ((np.frombuffer(piece, np.uint8), np.array([0, len(piece)])) for _, piece in chunks_of(flat.tobytes(), 0, SLICE_BYTES))
        held = [np.zeros(0, np.int64)] * 3
        for body, ends in pieces:
            codes, row = term_codes(body, ends, begins)
            if known is not None:
                codes = known.find(codes)
                row, codes = row[codes >= 0], codes[codes >= 0]
            codes, row, n = np.append(held[0], codes), np.append(held[1], row + first), np.append(held[2], np.ones(len(codes), np.int64))
            order = np.lexsort((codes, row))
            codes, row, n = codes[order], row[order], n[order]
            new = np.flatnonzero(np.append(True, (np.diff(codes) != 0) | (np.diff(row) != 0))[: len(codes)])
            held = [codes[new], row[new], np.add.reduceat(n, new) if len(new) else n]
        yield held[0], held[1], held[2]


class Vocabulary(NamedTuple):
    """codes ascend; once, again: the term of a code that is there, and that is there twice or more (-1: no such term); idf by term."""

    codes: np.ndarray
    once: np.ndarray
    again: np.ndarray
    idf: np.ndarray

    def begins(self) -> np.ndarray:
        """Marks of the first LEAST_BYTES bytes that some code has."""
        marks = np.zeros(1 << 8 * LEAST_BYTES, bool)
        for code in self.codes.tolist():
            marks[int.from_bytes((code % (1 << 64)).to_bytes(8, "big").lstrip(b"\0")[:LEAST_BYTES], "big")] = True
        return marks

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The place of each code, -1 for codes that are not here."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, at, -1)

    def vector(self, places: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights at length one) of a text with so many of the codes at these places; none, if none of them is a term."""
        once, again = self.once[places], self.again[places]
        first, second = once >= 0, (again >= 0) & (counts > 1)
        terms = np.concatenate([once[first], again[second]])
        weights = (1 + np.log(np.concatenate([counts[first], counts[second] - 1]))) * self.idf[terms]
        order = np.argsort(terms)
        return terms[order], weights[order] / np.sqrt((weights * weights).sum())


def vocabulary(found: list[tuple[int, bool, int]], total: int) -> Vocabulary:
    """found: (code, whether twice or more, texts that have it), in order."""
    codes = np.array(sorted({c for c, _, _ in found}), np.int64)
    places = [np.full(len(codes), -1), np.full(len(codes), -1)]
    for term, (code, twice, _) in enumerate(found):
        places[twice][np.searchsorted(codes, code)] = term
    return Vocabulary(codes, *places, np.log(1 + total / np.array([n for _, _, n in found], float)))


def vectors(column: pa.Array, known: Vocabulary) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, terms, weights at length one) of every row that has any known term."""
    for places, row, n in term_counts(column, known):
        cuts = np.flatnonzero(np.diff(row)) + 1
        for own, at, counts in zip(np.split(row, cuts), np.split(places, cuts), np.split(n, cuts), strict=True):
            terms, weights = known.vector(at, counts)
            if len(terms):
                yield int(own[0]), terms, weights


class Examples:
    """Labelled vectors under a block-max inverted index."""

    def __init__(self, ids: list[int | None], labels: list[int], terms: list[np.ndarray], weights: list[np.ndarray], n_terms: int) -> None:
        # Examples of the same heaviest term lie together, which keeps the bounds of blocks tight.
        head = [int(t[np.argmax(w)]) for t, w in zip(terms, weights, strict=True)]
        order = sorted(range(len(ids)), key=lambda i: (head[i], ids[i] is None, ids[i] or 0, i))
        self.ids = [ids[i] for i in order]
        self.labels = np.array([labels[i] for i in order], np.int64)
        #: Rank of each example by id, by which ties are decided.
        self.turn = np.empty(len(order), np.int64)
        self.turn[sorted(range(len(order)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0, i))] = np.arange(len(order))
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([terms[i] for i in order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([weights[i] for i in order] or [np.zeros(0)])
        example = np.repeat(np.arange(len(order)), [len(terms[i]) for i in order])
        by = np.lexsort((example, term))
        term, self.example, self.weight = term[by], example[by], weight[by]
        # One entry per term and block that meet: its postings and the largest weight among them.
        key = term * max(1, self.blocks) + self.example // BLOCK
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        self.begin = np.append(begins, len(key))
        self.block = (self.example // BLOCK)[begins]
        self.top = np.maximum.reduceat(self.weight, begins) if len(begins) else np.zeros(0)
        self.of_term = np.searchsorted(term[begins], np.arange(n_terms + 1))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(examples, cosines to 12 places) of the k largest cosines above 0, ties to the smaller id; `but` is left out."""
        entries, weight_of = _spans(self.of_term[terms], self.of_term[terms + 1], weights)
        bound = np.bincount(self.block[entries], weight_of * self.top[entries], self.blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        found, cosines, at, some = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(order):
            # A few blocks at a time, more each time. Sums in another order may differ in their last digits: the bound is met with a little room.
            now = order[at : at + some]
            now = now[bound[now] >= cosines[-1] - 1e-9] if len(cosines) == k else now
            if not len(now):
                break
            at, some = at + some, some * 4
            place = np.full(self.blocks, -1)
            place[now] = np.arange(len(now))
            own = place[self.block[entries]] >= 0
            postings, query = _spans(self.begin[entries[own]], self.begin[entries[own] + 1], weight_of[own])
            example = self.example[postings]
            sums = np.bincount(place[example // BLOCK] * BLOCK + example % BLOCK, query * self.weight[postings], len(now) * BLOCK)
            # Equal cosines of different sums differ in their last digits.
            sums = np.round(sums, 12)
            new = np.flatnonzero(sums)
            examples = now[new // BLOCK] * BLOCK + new % BLOCK
            kept = examples != but
            found, cosines = np.append(found, examples[kept]), np.append(cosines, sums[new[kept]])
            best = np.lexsort((self.turn[found], -cosines))[:k]
            found, cosines = found[best], cosines[best]
        return found, cosines

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours, near ones weigh more."""
        weight = 1 / (np.maximum(1 - cosines, 0) + SOFT)
        return float((weight * self.labels[found]).sum() / weight.sum())


def _spans(begin: np.ndarray, end: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers begin .. end - 1 of each span, and the span's value with each."""
    n = end - begin
    return np.arange(int(n.sum())) + np.repeat(begin - np.cumsum(n) + n, n), np.repeat(values, n)


class Curve(NamedTuple):
    """Votes -> probabilities: a monotone polyline."""

    votes: np.ndarray
    shares: np.ndarray

    def of(self, vote: float) -> float:
        return float(np.interp(vote, self.votes, self.shares))


def fit_curve(votes: np.ndarray, labels: np.ndarray) -> Curve:
    """Pooled adjacent violators over votes in order, with one case of label 0 at vote 0 and one of label 1 at vote 1."""
    votes, labels = np.concatenate([[0.0, 1.0], votes]), np.concatenate([[0.0, 1.0], labels])
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for vote, label in zip(votes[order].tolist(), labels[order].tolist(), strict=True):
        if pools and pools[-1][3] == vote:
            pools[-1][0] += label
            pools[-1][1] += 1
            pools[-1][2] += vote
        else:
            pools.append([label, 1, vote, vote])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2], last[3]]
    # Half a case of either label keeps shares off 0 and 1.
    shares = [(p[0] + 0.5) / (p[1] + 1) for p in pools]
    return Curve(np.array([p[2] / p[1] for p in pools]), np.maximum.accumulate(shares))


class Judge(NamedTuple):
    known: Vocabulary
    examples: Examples
    curve: Curve
    #: Probability of texts without any known term.
    base: float


def _counted(sample: DataFrame) -> DataFrame:
    """code, twice, n, bad: labelled texts that have a term (twice: more than once), and those of label 1 among them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def sent() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True, axis=0)
            sums = [np.bincount(at, np.concatenate([h[c] for h in held]), len(keys)).astype(np.int64) for c in (1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1] == 1), *map(pa.array, sums)], ["code", "twice", "n", "bad"])

        for batch in batches:
            labels = np.asarray(batch.column(0))
            for codes, row, n in term_counts(batch.column(1)):
                for twice in (False, True):
                    own = n > twice
                    unique, at = np.unique(codes[own], return_inverse=True)
                    held.append((np.stack([unique, np.full(len(unique), int(twice))], 1), np.bincount(at, minlength=len(unique)), np.bincount(at, labels[row[own]], len(unique))))
                    size += len(unique)
                if size > HELD_TERMS:
                    yield sent()
                    held, size = [], 0
        if held:
            yield sent()

    counts = sample.select("label", "text").mapInArrow(frugal(work), "code long, twice boolean, n long, bad long")
    return counts.groupBy("code", "twice").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def fit(docs: DataFrame, labels: DataFrame, column: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> Judge:
    """A judge made of at most `rows` labelled documents that are not held out, those of the smallest hashed ids.

    A document with several labels has the largest one. Without labelled rows, or without terms that tell labels apart, every text gets
    the base probability (0.25 without any rows).
    """
    labelled = labels.select("doc_id", F.col(label).cast("long").alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    chosen = labelled.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(column), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Ids may repeat in documents: rows are bounded again.
    sample = settled(sample.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_n = 1").drop("_n"))
    total, bad = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    with_term, bad_with = F.col("n").cast("double"), F.col("bad").cast("double")
    cross = bad_with * (total - with_term - bad + bad_with) - (with_term - bad_with) * (bad - bad_with)
    chi = total * cross * cross / (with_term * (total - with_term) * bad * (total - bad))
    terms = _counted(sample).where((F.col("n") >= LEAST_DOCS) & (F.col("n") < total)).withColumn("chi", chi).where(F.col("chi") >= LEAST_CHI)
    found = terms.orderBy(F.desc("chi"), "code", "twice").limit(TERMS).select("code", "twice", "n").collect() if 0 < bad < total else []
    known = vocabulary(sorted(map(tuple, found)), total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(vectors(batch.column(2), known))
            at = pa.array([row for row, _, _ in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([t for _, t, _ in made], pa.list_(pa.int64())), pa.array([w for _, _, w in made], pa.list_(pa.float64()))], ["doc_id", "label", "terms", "weights"])

    held = sample.select("doc_id", "label", "text").mapInArrow(frugal(work), "doc_id long, label long, terms array<long>, weights array<double>").toArrow().sort_by("doc_id").to_pydict() if len(found) else {"doc_id": [], "label": [], "terms": [], "weights": []}
    examples = Examples(held["doc_id"], held["label"], [np.array(t, np.int64) for t in held["terms"]], [np.array(w) for w in held["weights"]], len(found))
    rest, bad_rest = total - len(held["label"]), bad - sum(held["label"])
    return Judge(known, examples, _calibrated(examples, held), (bad_rest + 0.5) / (rest + 2))


def _calibrated(examples: Examples, held: dict[str, list]) -> Curve:
    """The curve over votes that each example gets from the others."""
    place = {doc_id: at for at, doc_id in enumerate(examples.ids)}
    votes, labels = [], []
    for doc_id, label, terms, weights in zip(*held.values(), strict=True):
        found, cosines = examples.nearest(np.array(terms), np.array(weights), NEAREST, but=place[doc_id])
        if len(found):
            votes.append(examples.vote(found, cosines))
            labels.append(label)
    return fit_curve(np.array(votes, float), np.array(labels, float))


def score_toxicity(docs: DataFrame, judge: Judge, column: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = NEAREST) -> DataFrame:
    """The kept columns, `score` double (0 to 1, higher where label 1 is likelier), `evidence`: the examples that voted, nearest first.

    A text without known terms (null and empty ones too) has the base score and no evidence. Equal texts have equal scores, repeated
    rows stay. Only the text is an input; names of other columns do not matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, examples, curve, base = judge
        kind = pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int64())])
        for batch in batches:
            scores, evidence = np.full(batch.num_rows, base), [[] for _ in range(batch.num_rows)]
            for row, terms, weights in vectors(batch.column(len(keep)), known):
                found, cosines = examples.nearest(terms, weights, k)
                if len(found):
                    scores[row] = curve.of(examples.vote(found, cosines))
                    evidence[row] = [{"doc_id": examples.ids[e], "cosine": min(1.0, c), "label": y} for e, c, y in zip(found.tolist(), cosines.tolist(), examples.labels[found].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array(evidence, pa.list_(kind))], [*keep, "score", "evidence"])

    source = lean(docs).select(*keep, F.col(column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(frugal(work), f"{schema}, score double, evidence array<struct<doc_id: long, cosine: double, label: long>>")
