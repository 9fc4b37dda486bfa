"""Exact repeated passages by sparse suffix arrays.

Suffixes are kept only where content selects them: at the minimisers of k-word grams, one of which lies in
every passage of the wanted length. A passage around a position reaches far to its right or far to its left, so a suffix
is listed under the print of its next words, of the words on its left, or both; only those that two places have
are looked at again. The suffixes of a print are then extended: every passage of the wanted length that reaches from the print
to the left and right is sorted by a hash of its further words, and neighbours are compared word hash by word hash. A chain of
neighbours in suffix order alone would miss pairs that agree less to the right and more to the left. What two or more
places share is a repeat, and adjoining repeated passages are one stretch; the place with the smallest document id and position stays.

A print of over HOT_PLACES places, the most that a task holds at a time, is split into whole passages, whose first
places are pre-aggregated.

Equal texts (by 128 bits) are handled once: the copies of a text are repeats of its first document as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import byte_slices, frugal, lean, settled
from palisade.llm.shingles import BASE, BYTE_CODES, mixed, powers, words

#: Words of the shortest repeat, and of the gram that selects a position.
MIN_WORDS, GRAM = 50, 8
LAST = (1 << 63) - 1
#: Places of a print from which on it is split by whole passages; rows that are compared at a time, about.
HOT_PLACES, COMPARED = 20_000, 20_000
#: Lists of up to so many numbers (8 bytes each) are broadcast; longer ones are joined by shuffle.
BROADCAST_NUMBERS = 1_000_000
#: Texts with such prints up to which their 64-bit keys (at most 128 MB) are broadcast, so that only they are shuffled.
BROADCAST_TEXTS = 4_000_000
OTHER_BASE = np.uint64(0xC2B2AE3D27D4EB4F)


def window_prints(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit print of every run of `width` words, by a polynomial over word hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for at, power in enumerate(powers(width).tolist()):
        total += hashes[at : at + n] * np.uint64(power)
    return mixed(total ^ BASE)


def minimisers(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, first window of each): the leftmost smallest gram of every run of `width` grams."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    chosen = np.empty(n, np.int64)
    for lo in range(0, n, 65_536):
        hi = min(n, lo + 65_536)
        chosen[lo:hi] = np.arange(lo, hi) + np.lib.stride_tricks.sliding_window_view(grams[lo : hi + width - 1], width).argmin(1)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    return chosen[first], first


class Side(NamedTuple):
    """The words of a passage that its print covers: `left` before the selected position and `right` from it on."""

    left: int
    right: int


def sides(min_words: int) -> tuple[Side, Side]:
    """Every passage of min_words that holds a selected gram has all words of the first or of the second side."""
    right = max(1, min_words * 3 // 5)
    return Side(0, right), Side(min_words - right + 1, GRAM)


class Anchors(NamedTuple):
    """Selected positions of a text, each with a side and with the least and greatest offset of its passages' starts."""

    at: np.ndarray
    side: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _anchors(hashes: np.ndarray, min_words: int) -> Anchors:
    at, first = minimisers(window_prints(hashes, GRAM), min_words - GRAM + 1)
    after = np.append(first[1:], max(0, len(hashes) - min_words + 1))
    least, most = at - after + 1, at - first
    one, two = sides(min_words)
    far = min_words - one.right
    rows = [(at, np.zeros(len(at), np.int64), least, np.minimum(most, far)), (at, np.ones(len(at), np.int64), np.maximum(least, two.left), most)]
    rows = [[column[low <= high] for column in (at, side, low, high)] for at, side, low, high in rows]
    return Anchors(*map(np.concatenate, zip(*rows, strict=True)))


def _spread(hashes: np.ndarray, begins: np.ndarray, width: int) -> np.ndarray:
    """The words begins .. begins + width - 1, one row each."""
    return hashes[begins[:, None] + np.arange(width)]


def _prints(hashes: np.ndarray, begins: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit prints of the words from each place on."""
    rows = _spread(hashes, begins, width)
    other = np.cumprod(np.full(width, OTHER_BASE))
    return mixed((rows * powers(width)).sum(1, dtype=np.uint64) ^ BASE), mixed((mixed(rows ^ OTHER_BASE) * other).sum(1, dtype=np.uint64))


def _cores(hashes: np.ndarray, found: Anchors, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Both prints of what each anchor's side covers."""
    low, high = np.empty(len(found.at), np.uint64), np.empty(len(found.at), np.uint64)
    for number, side in enumerate(sides(min_words)):
        own = np.flatnonzero(found.side == number)
        low[own], high[own] = _prints(hashes, found.at[own] - side.left, side.left + side.right)
    return low, high


def _bytes16(low: np.ndarray, high: np.ndarray) -> pa.Array:
    data = np.stack([low, high], 1).tobytes()
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(low), [None, pa.py_buffer(data)]).cast(pa.binary())


def _ends(parts: list) -> pa.Array:
    return pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _suffixes(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, h (128 bits of the text), n (words), cores and at (twice the selected position, plus the side) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, flat, offsets in byte_slices(batch.column(2)):
                hashes, _, _, by_text = words(flat, offsets, BYTE_CODES)
                cores, places = [], []
                for a, b in zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True):
                    found = _anchors(hashes[a:b], min_words)
                    cores.append(_cores(hashes[a:b], found, min_words)[0])
                    places.append(2 * found.at + found.side)
                ends = _ends(places)
                lists = [pa.ListArray.from_arrays(ends, pa.array(_joined(cores, np.uint64).view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(_joined(places, np.int64).astype(np.int32)))]
                kept = [batch.column(c).slice(first, last - first) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(by_text).astype(np.int32)), *lists], ["doc_id", "h", "n", "cores", "at"])

    return docs.select("doc_id", "h", "text").mapInArrow(frugal(work), "doc_id long, h binary, n int, cores array<long>, at array<int>")


def _wanted(batch: pa.RecordBatch, min_words: int, hot: bool) -> Iterator[tuple[int, np.ndarray, Anchors]]:
    """(row, word hashes, anchors) of the batch's texts that have anchors listed as hot, or as not."""
    for first, last, flat, offsets in byte_slices(batch.column(3)):
        hashes, _, _, by_text = words(flat, offsets, BYTE_CODES)
        for row, listed in enumerate(batch.column(2).slice(first, last - first)):
            codes = np.array(listed.values, np.int64)
            codes = codes[(codes & 1) == hot] >> 1
            if len(codes):
                own = hashes[by_text[row] : by_text[row + 1]]
                found = _anchors(own, min_words)
                keep = np.isin(2 * found.at + found.side, codes)
                yield first + row, own, Anchors(*[column[keep] for column in found])


def _extended(docs: DataFrame, min_words: int) -> DataFrame:
    """core, first_id, h, start, side, least, around: the wanted suffixes with the words on both sides of their core.

    start is the word where their first passage begins, which has the greatest offset; the others begin one word later each.
    """
    both = sides(min_words)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, lows, highs, starts, kinds, counts, around = [], [], [], [], [], [], []
            for row, hashes, found in _wanted(batch, min_words, False):
                low, high = _cores(hashes, found, min_words)
                take.append(np.full(len(low), row))
                lows.append(low)
                highs.append(high)
                starts.append(found.at - found.most)
                kinds.append(found.side)
                counts.append(found.least)
                for at, number, least, most in zip(*[column.tolist() for column in found], strict=True):
                    side = both[number]
                    around.append(np.concatenate([hashes[at - most : at - side.left], hashes[at + side.right : at + min_words - least]]))
            rows = pa.array(_joined(take, np.int64))
            columns = [_bytes16(_joined(lows, np.uint64), _joined(highs, np.uint64)), *[batch.column(c).take(rows) for c in (0, 1)]]
            columns += [pa.array(_joined(x, np.int64).astype(np.int32)) for x in (starts, kinds, counts)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(_ends(around), pa.array(_joined(around, np.uint64).view(np.int64)))], ["core", "first_id", "h", "start", "side", "least", "around"])

    return docs.select("first_id", "h", "wanted", "text").mapInArrow(frugal(work), "core binary, first_id long, h binary, start int, side int, least int, around array<long>")


STRETCH = "h binary, first_id long, start_word int, end_word int, kept boolean, first_doc_id long"


def _compare(rows: pa.Table, min_words: int) -> pa.RecordBatch:
    """Repeats among suffixes that are sorted by core, document and position and hold their cores whole."""
    core = rows.column("core").combine_chunks()
    marks = np.frombuffer(b"".join(core.to_pylist()), np.uint64).reshape(-1, 2)
    group = np.cumsum(np.concatenate([[0], (marks[1:] != marks[:-1]).any(1)]))
    side, start, doc = (np.array(rows.column(c), np.int64) for c in ("side", "start", "first_id"))
    lists = rows.column("around").combine_chunks()
    around, ends = np.array(lists.flatten(), np.int64).view(np.uint64), np.concatenate([[0], np.cumsum(np.array(lists.value_lengths(), np.int64))])
    names = [c.split()[0] for c in STRETCH.split(", ")]
    out = []
    for number, own_side in enumerate(sides(min_words)):
        width = min_words - own_side.left - own_side.right
        own = np.flatnonzero(side == number)
        # Passages of each suffix: as many as its words around the core have places for.
        n = ends[own + 1] - ends[own] - width + 1
        row = np.repeat(own, n)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        if not len(row):
            continue
        text = _spread(around, ends[row] + turn, width) if width else np.zeros((len(row), 0), np.uint64)
        # Suffixes of one core are aligned by it: equal passages have the same offset.
        offset = np.array(rows.column("least"), np.int64)[row] + n[np.searchsorted(own, row)] - 1 - turn
        fold = mixed((text * powers(width)).sum(1, dtype=np.uint64)) if width else np.zeros(len(row), np.uint64)
        order = np.lexsort((fold, offset, group[row]))
        if (_fresh(group[row], offset, text, order) != _fresh(group[row], offset, fold[:, None], order)).any():
            # Different words with one hash between the same neighbours: sort by the words themselves.
            order = np.lexsort((*text.T[::-1], offset, group[row]))
        fresh = _fresh(group[row], offset, text, order)
        number_of = np.cumsum(fresh) - 1
        lead = order[fresh]
        many = np.bincount(number_of)[number_of] > 1
        source, kept, repeated = np.empty(len(row), np.int64), np.zeros(len(row), bool), np.zeros(len(row), bool)
        source[order], repeated[order] = doc[row[lead]][number_of], many
        kept[lead] = True
        # Neighbouring passages of one suffix with one fate are one stretch.
        own_rows = np.flatnonzero(repeated)
        if not len(own_rows):
            continue
        before = own_rows[:-1]
        breaks = (own_rows[1:] != before + 1) | (row[own_rows[1:]] != row[before]) | (kept[own_rows[1:]] != kept[before]) | (source[own_rows[1:]] != source[before])
        heads = np.flatnonzero(np.concatenate([[True], breaks]))
        tails = np.append(heads[1:], len(own_rows)) - 1
        head, last = own_rows[heads], own_rows[tails]
        at = pa.array(row[head])
        out.append(pa.table([rows.column("h").take(at), rows.column("first_id").take(at), pa.array((start[row[head]] + turn[head]).astype(np.int32)), pa.array((start[row[head]] + turn[last] + min_words).astype(np.int32)), pa.array(kept[head]), pa.array(source[head])], names=names))
    if not out:
        return pa.RecordBatch.from_arrays([pa.array([], kind) for kind in (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64())], names)
    return pa.concat_tables(out).combine_chunks().to_batches()[0]


def _fresh(group: np.ndarray, offset: np.ndarray, text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether each passage in order differs from its neighbour before it."""
    if not len(order):
        return np.zeros(0, bool)
    a, b = order[1:], order[:-1]
    return np.concatenate([[True], (group[a] != group[b]) | (offset[a] != offset[b]) | (text[a] != text[b]).any(1)])


def _stretches(suffixes: DataFrame, min_words: int) -> DataFrame:
    """Compares the suffixes of each core; cores are read one after the other, COMPARED rows or so at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            core = batch.column(0)
            cut = batch.num_rows
            if sum(b.num_rows for b in held) + cut >= COMPARED:
                # All but the batch's last core are whole.
                while cut and core[cut - 1] == core[batch.num_rows - 1]:
                    cut -= 1
                if cut or (held and held[-1].column(0)[-1] != core[0]):
                    yield _compare(pa.Table.from_batches([*held, batch.slice(0, cut)]), min_words)
                    held, batch = [], batch.slice(cut)
            held.append(batch)
        if held:
            yield _compare(pa.Table.from_batches(held), min_words)

    ordered = suffixes.repartition("core").sortWithinPartitions("core", "first_id", "h", "start", "side")
    return ordered.mapInArrow(frugal(work), STRETCH)


def _hot_stretches(docs: DataFrame, min_words: int) -> DataFrame:
    """The same for suffixes of hot cores: their passages one by one, by 128 bits, first places pre-aggregated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, hashes, found in _wanted(batch, min_words, True):
                starts = np.unique(np.concatenate([np.arange(at - most, at - least + 1) for at, least, most in zip(found.at, found.least, found.most, strict=True)]))
                for begin in range(0, len(starts), COMPARED):
                    own = starts[begin : begin + COMPARED]
                    rows = pa.array(np.full(len(own), row))
                    yield pa.RecordBatch.from_arrays([_bytes16(*_prints(hashes, own, min_words)), *[batch.column(c).take(rows) for c in (0, 1)], pa.array(own.astype(np.int32))], ["passage", "first_id", "h", "start_word"])

    passages = docs.select("first_id", "h", "wanted", "text").mapInArrow(frugal(work), "passage binary, first_id long, h binary, start_word int")
    place = F.struct("first_id", "h", "start_word")
    first = passages.groupBy("passage").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    # Written first, so that the join meets two plain shuffles, and one hot passage can be split over tasks.
    first = settled(first.select(F.col("passage").alias("_passage"), "first"))
    both = passages.join(first, F.col("passage") == F.col("_passage"))
    return both.select("h", "first_id", "start_word", (F.col("start_word") + min_words).alias("end_word"), (place == F.col("first")).alias("kept"), F.col("first.first_id").alias("first_doc_id"))


def _merged(stretches: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping and touching stretches of equal keys as one."""
    order = Window.partitionBy(*keys).orderBy("start_word", "end_word")
    before = F.max("end_word").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = stretches.withColumn("_new", (before.isNull() | (F.col("start_word") > before)).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word")).drop("_island")


def text_id(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, h, start_word, end_word (exclusive), n_words, kept, first_doc_id: one row per repeated stretch and document.

    kept marks the place that stays (the smallest document id, then position); all others repeat it. Words
    are what white space (blank, tab to carriage return) separates, compared exactly. Rows with fewer than
    min_words words (also null and empty texts) have no repeats. Rows equal in id and text count as one
    document. Null ids come last in the order. An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    docs = lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_id(text).alias("h"))
    found = settled(_suffixes(docs, min_words))
    pairs = found.where(F.col("n") >= min_words).groupBy("h", F.coalesce("doc_id", F.lit(LAST)).alias("doc_id")).agg(F.count("*").alias("rows"), F.first("n").alias("n"))
    pairs = settled(pairs)
    texts = pairs.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max("rows").alias("rows"), F.first("n").alias("n"))
    texts = settled(texts)
    suffixes = found.select("h", F.explode(F.arrays_zip("cores", "at")).alias("s")).select("h", F.col("s.cores").alias("core"), F.col("s.at").alias("at"))
    # A core in two places: the least and the greatest print of its places differ. Hot cores are pre-aggregated.
    place = F.xxhash64("h", "at")
    twice = suffixes.groupBy("core").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count("*").alias("places")).where("a <> b")
    # Written first, so that the join meets two plain shuffles, and one hot core can be split over tasks.
    twice = settled(twice.select("core", (F.col("places") > HOT_PLACES).cast("int").alias("hot")))
    wanted = suffixes.join(twice, "core").groupBy("h").agg(F.collect_set(2 * F.col("at").cast("long") + F.col("hot")).alias("wanted"))
    wanted = settled(wanted.join(texts.select("h", "first_id", "rows"), "h").withColumnRenamed("h", "_h"))
    if wanted.count() <= BROADCAST_TEXTS:
        keys = wanted.select(F.xxhash64("_h").alias("_key")).distinct()
        docs = docs.join(F.broadcast(keys), F.xxhash64("h") == F.col("_key"), "left_semi")
    chosen = docs.join(wanted, (docs["h"] == F.col("_h")) & (F.coalesce("doc_id", F.lit(LAST)) == F.col("first_id")))
    chosen = chosen.select("first_id", "h", "wanted", "text", "rows")
    if not wanted.where("rows > 1").isEmpty():
        # Rows equal in id and text are one document; one of them is left before anything is shuffled by text.
        chosen = chosen.where("rows = 1").unionByName(chosen.where("rows > 1").dropDuplicates(["first_id", "h"]))
    stretches = _stretches(_extended(chosen, min_words), min_words)
    if not twice.where("hot = 1").isEmpty():
        stretches = stretches.unionByName(_hot_stretches(chosen, min_words))
    own = _merged(stretches, ["h", "first_id", "kept", "first_doc_id"]).select(F.col("first_id").alias("doc_id"), "h", "start_word", "end_word", "kept", "first_doc_id")
    several = texts.where("first_id <> last_id")
    copies = pairs.join(several.select("h", "first_id"), "h").where("doc_id <> first_id")
    whole = copies.select("doc_id", "h", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), F.lit(False).alias("kept"), F.col("first_id").alias("first_doc_id"))
    origin = several.select(F.col("first_id").alias("doc_id"), "h", F.lit(0).alias("start_word"), F.col("n").alias("end_word"), F.lit(True).alias("kept"), F.col("first_id").alias("first_doc_id"))
    out = own.unionByName(whole).unionByName(origin).distinct()
    return out.select(F.nullif("doc_id", F.lit(LAST)).alias("doc_id"), "h", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "kept", F.nullif("first_doc_id", F.lit(LAST)).alias("first_doc_id"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    data = text.encode()
    flat = np.frombuffer(data, np.uint8)
    _, first, last, _ = words(flat, np.array([0, len(flat)]), BYTE_CODES)
    out, at = [], 0
    for a, b in sorted(spans):
        begin, end = int(first[a]), int(first[b]) if b < len(first) else len(data)
        if begin > at:
            out.append(data[at:begin])
        at = max(at, end)
    return b"".join([*out, data[at:]]).decode()


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with every repeat cut from its text except where it is kept; texts without repeats are untouched.

    A document that is a repeat as a whole keeps its row, with an empty text.
    """
    found = repeated_passages(docs, min_words).where("not kept")
    spans = settled(found.groupBy(F.col("doc_id").alias("__cut_id"), F.col("h").alias("__cut_h")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__cut_spans")))
    small = (spans.agg(F.sum(F.size("__cut_spans") + 8)).first()[0] or 0) <= BROADCAST_NUMBERS
    same = docs["doc_id"].eqNullSafe(spans["__cut_id"]) & (text_id(F.coalesce(docs["text"], F.lit(""))) == spans["__cut_h"])
    both = docs.join(F.broadcast(spans) if small else spans, same, "left")
    text = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, _, _ in byte_slices(batch.column(text)):
                part = batch.slice(first, last - first)
                *kept, cuts = part.columns
                new = [without_words(t, [(s["start_word"], s["end_word"]) for s in c]) if c else t for t, c in zip(kept[text].to_pylist(), cuts.to_pylist(), strict=True)]
                kept[text] = pa.array(new, pa.string())
                yield pa.RecordBatch.from_arrays(kept, part.schema.names[:-1])

    return both.select(*docs.columns, "__cut_spans").mapInArrow(frugal(work), docs.schema)
