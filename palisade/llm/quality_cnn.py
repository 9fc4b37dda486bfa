"""Quality of whole texts by a byte-level convolutional network in numpy.

Bytes pass through learned filters of 8 bytes at every second byte; the responses of a chunk of 256
positions (chunks overlap by half, together they cover the document) are max-pooled, and the chunks are
combined by their maximum and their mean into one logistic unit. Embedding and convolution are one
lookup table per filter tap, so a document of any length costs a few table reads per byte. Max-pooled filters cannot tell
a word from the same word again, so one more channel says how far the text echoes itself: the share of equal
bytes at the best of a few lags, pooled like the others. Responses are made and pooled a segment at a time; half chunks do not straddle segments, so that the result is that of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import byte_slices, frugal, lean

TAPS, STRIDE = 8, 2
CHUNK, HOP = 256, 128
#: Distances at which the text is compared with itself, and bytes of a block whose echoes are counted (three make a window).
LAGS, ECHO = range(2, 18), 16
#: Positions whose responses are held at a time.
SEGMENT = 128 * HOP
#: Labelled rows that the network is fitted on, at most, their bytes, and bytes of the longest; rows of a training step.
FIT_ROWS, FIT_BYTES, FIT_TEXT = 3_000, 64 << 20, 1 << 20
BATCH = 32


class ByteCnn(NamedTuple):
    """taps (TAPS, 256, filters), bias (filters,), dense (2 * (filters + 1),): maxima and means of filters and echo, offset."""

    taps: np.ndarray
    bias: np.ndarray
    dense: np.ndarray
    offset: float


def places(text: np.ndarray) -> tuple[np.ndarray, int]:
    """The text, filled to TAPS bytes, and the number of its positions.

    The last position is taken even if the stride would skip it, so that every byte is seen.
    """
    if len(text) < TAPS:
        text = np.pad(text, (0, TAPS - len(text)))
    return text, -(-(len(text) - TAPS) // STRIDE) + 1


def responses(text: np.ndarray, first: int, last: int, taps: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Rectified filter responses of the positions first .. last - 1, one row each."""
    starts = np.minimum(np.arange(first, last) * STRIDE, len(text) - TAPS)
    out = np.repeat(bias[None], len(starts), 0)
    for tap in range(TAPS):
        out += taps[tap].take(text[starts + tap], 0)
    return np.maximum(out, 0, out=out)


def echoes(text: np.ndarray, first: int, last: int) -> np.ndarray:
    """Per half chunk first .. last - 1: the square of twice the greatest share of bytes of a window that equal those a lag before."""
    size = HOP * STRIDE
    begin, end = first * size, min(len(text), last * size)
    # Two blocks before the first make its windows whole.
    start = max(0, begin - 2 * ECHO)
    blocks = -(-(end - start) // ECHO)
    best = np.zeros(blocks, np.int32)
    same = np.zeros(blocks * ECHO, np.uint8)
    for lag in LAGS:
        low = max(start, lag)
        same[:] = 0
        if low < end:
            np.equal(text[low:end], text[low - lag : end - lag], out=same[low - start : end - start].view(bool))
        counts = same.reshape(-1, ECHO).sum(1, dtype=np.int32)
        window = counts.copy()
        window[1:] += counts[:-1]
        window[2:] += counts[:-2]
        np.maximum(best, window, out=best)
    shares = (2 * best[(begin - start) // ECHO :] / np.float32(3 * ECHO)) ** 2
    whole = np.zeros((last - first) * size // ECHO, np.float32)
    whole[: len(shares)] = shares
    return whole.reshape(last - first, -1).max(1)


def half_chunks(text: np.ndarray, taps: np.ndarray, bias: np.ndarray, rows: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Maxima of every half chunk (filters, then echo), and the positions of the filters' maxima where rows asks for them."""
    text, n = places(text)
    tops, where = [], []
    for first in range(0, n, SEGMENT):
        own = responses(text, first, min(n, first + SEGMENT), taps, bias)
        top = np.maximum.reduceat(own, np.arange(0, len(own), HOP), 0)
        half = first // HOP
        tops.append(np.concatenate([top, echoes(text, half, half + len(top))[:, None]], 1))
        if rows:
            where += [first + at + own[at : at + HOP].argmax(0) for at in range(0, len(own), HOP)]
    return np.concatenate(tops), np.array(where) if rows else None


def pooled(halves: np.ndarray) -> np.ndarray:
    """(chunks, filters): the maxima of overlapping chunks, each two half chunks long (one where there is only one)."""
    return np.maximum(halves[:-1], halves[1:]) if len(halves) > 1 else halves


def features(text: np.ndarray, net: ByteCnn) -> np.ndarray:
    chunks = pooled(half_chunks(text, net.taps, net.bias)[0])
    return np.concatenate([chunks.max(0), chunks.mean(0)])


def score(text: np.ndarray, net: ByteCnn) -> float:
    """Probability of label 1."""
    z = features(text, net) @ net.dense + net.offset
    return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[bytes], labels: np.ndarray, filters: int = 16, epochs: int = 8, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the logistic loss, gradients through the maxima only. Deterministic for given rows in order.

    Without both classes the network is constant: the smoothed share of label 1.
    """
    rng = np.random.default_rng(seed)
    prior = (labels.sum() + 1.0) / (len(labels) + 2.0)
    taps = rng.normal(0, 0.15, (TAPS, 256, filters)).astype(np.float32)
    net = ByteCnn(taps, np.zeros(filters, np.float32), np.zeros(2 * filters + 2, np.float32), float(np.log(prior / (1 - prior))))
    if len(set(labels.tolist())) < 2:
        return net
    params = [net.taps, net.bias, rng.normal(0, 0.1, 2 * filters + 2).astype(np.float32), np.array([net.offset], np.float32)]
    first, second, turn = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    data = [np.frombuffer(t, np.uint8) for t in texts]
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for begin in range(0, len(order), BATCH):
            grads = [np.zeros_like(p) for p in params]
            for i in order[begin : begin + BATCH]:
                _backward(data[i], float(labels[i]), params, grads)
            turn += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g /= BATCH
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    return ByteCnn(params[0], params[1], params[2], float(params[3][0]))


def _backward(text: np.ndarray, label: float, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
    taps, bias, dense, offset = params
    filters = len(bias)
    halves, best_rows = half_chunks(text, taps, bias, rows=True)
    text, _ = places(text)
    chunks = pooled(halves)
    where = np.arange(filters)
    top = chunks[:, :filters].argmax(0)
    x = np.concatenate([chunks.max(0), chunks.mean(0)])
    p = 1 / (1 + np.exp(-np.clip(float(x @ dense + offset[0]), -30, 30)))
    delta = np.float32(p - label)
    grads[2] += delta * x
    grads[3] += delta
    # Each chunk's maximum lies in one of its two halves; the gradient goes to that half's best row. The echo has no weights of its own.
    halves = halves[:, :filters]
    inner = np.repeat((delta * dense[filters + 1 : 2 * filters + 1] / len(chunks))[None], len(chunks), 0)
    inner[top, where] += delta * dense[:filters]
    onto = np.zeros_like(halves)
    if len(halves) > 1:
        right = halves[1:] > halves[:-1]
        onto[:-1] += np.where(right, 0, inner)
        onto[1:] += np.where(right, inner, 0)
    else:
        onto += inner
    used = (onto != 0) & (halves > 0)
    half, kind = np.nonzero(used)
    if not len(half):
        return
    best = best_rows[half, kind]
    value = onto[half, kind]
    np.add.at(grads[1], kind, value)
    starts = np.minimum(best * STRIDE, len(text) - TAPS)
    for tap in range(TAPS):
        np.add.at(grads[0][tap], (text[starts + tap], kind), value)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5. Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, column: str = "text") -> ByteCnn:
    """A network fitted on at most `rows` labelled documents (those of the smallest hashed ids) that are not held out.

    Together they hold FIT_BYTES at most; labelled texts over FIT_TEXT bytes are not learned from.
    """
    known = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # Twice the rows, as some labels may be of documents that are not here.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
    joined = docs.select("doc_id", F.col(column).alias("_text")).where(F.coalesce(F.octet_length("_text"), F.lit(0)) <= FIT_TEXT).join(F.broadcast(chosen), "doc_id")
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("_text"))
    sample = joined.orderBy(*order).limit(rows)
    # A running sum over at most `rows` rows.
    held = F.sum(F.coalesce(F.octet_length("_text"), F.lit(0)).cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = sample.withColumn("_held", held).where(F.col("_held") <= FIT_BYTES).select("_text", "quality").collect()
    return train([(r["_text"] or "").encode() for r in found], np.array([r["quality"] for r in found], float))


def score_quality(docs: DataFrame, net: ByteCnn, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and `score` double, 0 to 1, higher where label 1 is likelier.

    Null and empty texts are scored as bytes 0. Repeated rows stay, equal texts have equal scores. Only
    the text is an input; names of other columns do not matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for first, _, flat, offsets in byte_slices(batch.column(len(keep))):
                for i in range(len(offsets) - 1):
                    out[first + i] = score(flat[offsets[i] : offsets[i + 1]], net)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(out)], [*keep, "score"])

    source = lean(docs).select(*keep, F.col(column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(frugal(work), f"{schema}, score double")
