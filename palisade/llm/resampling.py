"""Importance resampling towards a target distribution, over hashed runs of words.

Each run of 1 to n words is hashed into a bucket; a bucket's gain is the scaled log ratio of its smoothed shares in
the target texts and in the corpus, a document's weight the sum of its runs' gains. Weight plus a Gumbel draw made of
the document's id is its score, and the highest scores are the sample: a draw without replacement.

A few long texts would hold up the tasks that they lie in. They are split at word boundaries into chunks of about
CHUNK_BYTES; a chunk owns the runs that start in it and carries the next n - 1 words along so that its last runs are whole.
Chunks are dealt over all tasks, and what they count and weigh is summed by document. The only state outside tasks is
one number per bucket. Ranks come from a sort by ranges and the sizes of the ranges, so no task orders all rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import byte_slices, frugal, lean, literal_rows, settled
from palisade.llm.word_runs import crc32_slices, joined_words, word_runs

#: Texts over so many bytes are split into chunks of about as many.
CHUNK_BYTES = 64 << 10
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def chunks_of(text: bytes, carry: int, size: int = CHUNK_BYTES) -> Iterator[tuple[int, bytes]]:
    """(bytes that the chunk owns, its bytes): cut where a word ends, with the next `carry` words after what is owned."""
    begin = 0
    while begin < len(text):
        gap = _GAP.search(text, begin + size)
        cut = gap.start() if gap else len(text)
        end = cut
        for _ in range(carry):
            word = _WORD.search(text, end)
            if word is None:
                break
            end = word.end()
        yield cut - begin, text[begin:end]
        begin = cut


def runs_in(flat: np.ndarray, offsets: np.ndarray, owned: np.ndarray | None, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every run of 1 to `runs` words, its text, words by text). owned: bytes of each text in which runs may start."""
    first, last, by_text = word_runs(flat, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(by_text))
    own = np.ones(len(first), bool) if owned is None else first - offsets[text] < owned[text]
    data, begin, end = joined_words(flat, first, last)
    found, of = [], []
    for width in range(1, runs + 1):
        n = max(0, len(first) - width + 1)
        whole = own[:n] & (text[:n] == text[width - 1 :])
        found.append(crc32_slices(data, begin[:n][whole], end[width - 1 :][whole]) % np.uint32(buckets))
        of.append(text[:n][whole])
    return np.concatenate(found), np.concatenate(of), np.bincount(text[own], minlength=len(offsets) - 1)


def _counting(runs: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for first, last, flat, offsets in byte_slices(batch.column(1)):
                owned = np.asarray(batch.column(0).slice(first, last - first))
                held += np.bincount(runs_in(flat, offsets, owned, runs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["bucket", "n"])

    return frugal(count)


def _parts(docs: DataFrame, column: str, id_column: str, runs: int) -> tuple[DataFrame, DataFrame]:
    """(short texts, chunks of the long ones): id, print, owned, body. Chunks are dealt over tasks by print and place.

    A long text is known by its id and print: rows equal in both count as copies of one.
    """
    rows = lean(docs).select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("text"))
    far = F.octet_length("text") > CHUNK_BYTES
    short = rows.where(~far).select("id", F.lit(None).cast("binary").alias("print"), F.octet_length("text").cast("long").alias("owned"), F.col("text").cast("binary").alias("body"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                for place, (owned, body) in enumerate(chunks_of(batch.column(2)[row].as_py(), runs - 1)):
                    yield pa.RecordBatch.from_pydict({"id": batch.column(0).slice(row, 1), "print": batch.column(1).slice(row, 1), "place": pa.array([place]), "owned": pa.array([owned]), "body": pa.array([body], pa.binary())})

    whole = rows.where(far).select("id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("print"), F.col("text").cast("binary").alias("body"))
    cut = whole.mapInArrow(frugal(split), "id long, print binary, place long, owned long, body binary")
    return short, cut.repartition("print", "place").select("id", "print", "place", "owned", "body")


def bucket_counts(docs: DataFrame, column: str, id_column: str, runs: int, buckets: int) -> np.ndarray:
    """Runs of all texts in each bucket. A task sends one number per bucket at most."""
    count = _counting(runs, buckets)
    short, cut = _parts(docs, column, id_column, runs)
    held = [part.select("owned", "body").mapInArrow(count, "bucket int, n long") for part in (short, cut)]
    out = np.zeros(buckets, np.int64)
    for bucket, n in held[0].unionByName(held[1]).groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln of the ratio of smoothed shares), in doubles."""
    n = len(corpus)
    ratio = (target + 1.0) * (float(corpus.sum()) + n) / ((corpus + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, runs: int, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """id, n_words, n_features, weight of every row: long texts are summed over their chunks."""
    buckets = len(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, words, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, flat, offsets in byte_slices(batch.column(batch.num_columns - 1)):
                owned = np.asarray(batch.column(batch.num_columns - 2).slice(first, last - first))
                bucket, text, words[first:last] = runs_in(flat, offsets, owned, runs, buckets)
                n[first:last] = np.bincount(text, minlength=last - first)
                np.add.at(weight[first:last], text, gain[bucket])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(words), pa.array(n), pa.array(weight)], [*batch.schema.names[:-2], "n_words", "n_features", "weight"])

    short, cut = _parts(docs, column, id_column, runs)
    sums = "n_words long, n_features long, weight long"
    short = short.select("id", "owned", "body").mapInArrow(frugal(work), f"id long, {sums}")
    cut = cut.mapInArrow(frugal(work), f"id long, print binary, place long, {sums}")
    copies = F.count_if(F.col("place") == 0)
    whole = cut.groupBy("id", "print").agg(copies.alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return short.unionByName(whole.select("id", *[F.expr(f"{c} div copies").alias(c) for c in ("n_words", "n_features", "weight")]))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, runs: int = 1, buckets: int = 10_000, least_words: int = 20, seed: str = "2024", column: str = "text", id_column: str = "doc_id", target_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank 1, 2, ... for those drawn, else null.

    Drawn are floor(percent * N / 100) of the N documents of at least `least_words` words. Null texts are empty: no feature,
    weight 0, a score, never drawn. A null id draws as the empty string and comes last among equals. Rows of one id
    share their draw, and each counts and may be drawn; equal scores of one id go by fewer features. An empty table gives
    no rows, an empty target a uniform one. Other columns may have any name.
    """
    gain = gains(bucket_counts(docs, column, id_column, runs, buckets), bucket_counts(target.select(F.lit(0).alias("_id"), F.col(target_column).alias("_text")), "_text", "_id", runs, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = weigh(docs, gain, runs, column, id_column).select("id", "n_words", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") < least_words).alias("_short"))
    scored = settled(scored)
    drawn = scored.where(~F.col("_short")).count() * percent // 100
    order = [F.col("_short"), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features")]
    # Numbers within a partition are the lower 33 bits of this id, the partition the upper ones.
    placed = settled(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    # One row per partition of the sort.
    sizes = placed.groupBy("_part").count().orderBy("_part").collect()
    before, rows = 0, []
    for part, n in sizes:
        rows.append({"_part": part, "_before": before})
        before += n
    rank = F.col("_before") + F.col("_at") + 1
    ranked = placed.join(F.broadcast(literal_rows(docs.sparkSession, rows, "_part long, _before long")), "_part")
    return ranked.select(F.col("id").alias("doc_id"), "n_words", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
