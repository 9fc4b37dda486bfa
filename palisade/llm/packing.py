"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents become token ids; only documents longer than a sequence are cut. Full pieces are sequences of
their own; all others are dealt into problems of bounded size. Each problem is solved on several islands. A population
starts from varied packings. Its crossover injects whole well-filled bins of one parent into another, removes the bins that
share documents with them, exchanges displaced documents for shorter ones where that fills a bin better, and best-fits
what is left; after each epoch an island's elite moves to the next. A search ends where a lower bound is reached.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import frugal, lean, settled, text_slices

#: Pieces of one packing problem, about; islands; epochs between migrations; packings of a population.
PROBLEM, ISLANDS, EPOCHS, POPULATION = 4_096, 2, 2, 6
#: Pieces that an epoch of one island handles, about: small problems get more generations than large ones.
EFFORT, MOST_GENERATIONS = 100_000, 2_000
#: Letters between white space from which on a text is left to the library, whose time per word grows slower.
LONG_WORD = 2_000


def _merge_encoding(spec: dict):
    """The file's merges as a tiktoken encoding, or None where they are not plain byte-level BPE in id order."""
    if sys.byteorder != "little" or array("I").itemsize != 4:
        return None
    model, pre = spec.get("model", {}), spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
    if not plain or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    import public_tokenizers
    import tiktoken

    # Byte-level files write a byte as itself where it is printable, the others as letters from U+0100 on.
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    letter = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(letter[c] for c in token): rank for token, rank in model["vocab"].items() if token not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made) or len(made) + 256 != len(ranks):
        return None
    return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class TextTokenizer:
    """Ids of texts as packed little-endian unsigned 32-bit numbers.

    Where the file is a plain byte-level BPE whose ids are in the order of its merges, the merges run in tiktoken over
    that file's vocabulary, which gives the same ids in a fraction of the time; any other file, texts with added
    tokens and texts with very long words go through the tokenizers library, which is loaded when first needed.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, self.library = path, None
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.merges = _merge_encoding(spec)

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.merges is None or any(s in text for s in self.special):
            return self._by_library(text)
        if len(text) > LONG_WORD and max(map(len, text.split()), default=0) > LONG_WORD:
            return self._by_library(text)
        return array("I", self.merges.encode_ordinary(text)).tobytes()


_coders: dict[str, TextTokenizer] = {}


def coder_of(path: str) -> TextTokenizer:
    """One tokenizer per worker and file."""
    if path not in _coders:
        _coders[path] = TextTokenizer(path)
    return _coders[path]


def pieces_of(packed: bytes, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document's ids: all of `size` but for the first, which holds the remainder."""
    n = len(packed) // 4
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


PIECE_SCHEMA = "row long, piece int, start long, length long, ids_crc32 long"


def tokenised(docs: DataFrame, path: str, size: int, end_id: int, keep: tuple[str, ...], column: str) -> DataFrame:
    """The pieces of all documents: kept columns, a row number of their own, piece, start, length, ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row, end = coder_of(path), TaskContext.get().partitionId() << 40, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for first, _, texts in text_slices(batch.column(len(keep))):
                take, found = [], []
                for i, text in enumerate(texts):
                    packed = coder.encode(text) + end
                    for n, (start, length) in enumerate(pieces_of(packed, size)):
                        take.append(first + i)
                        found.append((row, n, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)])))
                        row += 1
                kept = [batch.column(i).take(pa.array(take, pa.int64())) for i in range(len(keep))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)]], [*[f"k{i}" for i in range(len(keep))], "row", "piece", "start", "length", "ids_crc32"])

    source = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(column).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(frugal(work), f"{schema}, {PIECE_SCHEMA}")


class Bins:
    """Bins of one problem, with the room left of each; best fit in constant time by a bit set of rooms."""

    def __init__(self, lengths: np.ndarray, size: int):
        self.lengths, self.size = lengths, size
        self.items: list[list[int]] = []
        self.room: list[int] = []
        self.by_room: list[list[int]] = [[] for _ in range(size + 1)]
        self.rooms = 0

    def _file(self, which: int) -> None:
        room = self.room[which]
        self.by_room[room].append(which)
        self.rooms |= 1 << room

    def add_bin(self, items: list[int], room: int) -> None:
        self.items.append(items)
        self.room.append(room)
        self._file(len(self.items) - 1)

    def best_fit(self, items: list[int]) -> None:
        """Each item, longest first, into the fullest bin that takes it."""
        lengths, by_room = self.lengths, self.by_room
        for item in sorted(items, key=lambda i: (-lengths[i], i)):
            length = lengths[item]
            fitting = self.rooms >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                which = by_room[room].pop()
                if not by_room[room]:
                    self.rooms ^= 1 << room
                self.items[which].append(item)
                self.room[which] = room - length
                self._file(which)
            else:
                self.add_bin([item], self.size - length)

    def fitness(self) -> tuple[int, int]:
        """Smaller is better: the number of bins, then how evenly room is spread (one large hole is best)."""
        return len(self.items), -sum(r * r for r in self.room)


def lower_bound(lengths: list[int], size: int) -> int:
    """Bins that any packing needs: by the sum, and for every k by the pieces of which no two of more than size - k share a bin.

    Pieces over half a bin need one each; those of more than size - k leave room for nothing of k or more, so
    the pieces of k to half a bin must go beside the other large ones or into bins of their own.
    """
    count = np.bincount(lengths, minlength=size + 1)
    tokens = count * np.arange(size + 1)
    half, best = size // 2, -(-int(tokens.sum()) // size)
    for k in range(1, half + 1):
        huge, large = int(count[size - k + 1 :].sum()), int(count[half + 1 : size - k + 1].sum())
        spare = size * large - int(tokens[half + 1 : size - k + 1].sum())
        best = max(best, huge + large + max(0, -(-(int(tokens[k : half + 1].sum()) - spare) // size)))
    return best


def filled(lengths: list[int], size: int, rng: np.random.Generator, tries: int = 24) -> Bins:
    """Bin after bin: the longest piece left, then what comes closest to the room left as one piece or as two."""
    left: list[list[int]] = [[] for _ in range(size + 1)]
    for item, length in enumerate(lengths):
        left[length].append(item)
    there = sum(1 << length for length in range(size + 1) if left[length])
    out = Bins(lengths, size)

    def take(length: int) -> int:
        nonlocal there
        item = left[length].pop()
        if not left[length]:
            there ^= 1 << length
        return item

    while there:
        items, room = [], size
        while (fitting := there & ((1 << (room + 1)) - 1)) > 1 or (room == size and fitting):
            longest = fitting.bit_length() - 1
            if not items:
                items.append(take(longest))
                room -= longest
                continue
            # One piece leaves room - longest; two may leave less. Random first pieces keep packings different.
            first, spare = longest, room - longest
            if spare:
                for guess in rng.integers(1, room, tries).tolist() if room > 1 else ():
                    one = (there & ((1 << (guess + 1)) - 1)).bit_length() - 1
                    if one < 1:
                        continue
                    two = (there & ((1 << (room - one + 1)) - 1)).bit_length() - 1
                    if two >= 1 and room - one - two < spare and (two != one or len(left[one]) > 1):
                        first, spare = one, room - one - two
                        if not spare:
                            break
            items.append(take(first))
            room -= first
        out.add_bin(items, room)
    return out


def _exchanged(bins: Bins, loose: list[int]) -> list[int]:
    """Puts displaced pieces in the place of shorter ones where they fit, the fullest bins first; returns the displaced then."""
    lengths = bins.lengths
    by_length: dict[int, list[int]] = {}
    for item in loose:
        by_length.setdefault(lengths[item], []).append(item)
    there = sum(1 << length for length in by_length)
    for which in sorted(range(len(bins.items)), key=bins.room.__getitem__):
        room, items = bins.room[which], bins.items[which]
        if not room:
            continue
        for place, item in enumerate(items):
            length = lengths[item]
            better = (there & ((1 << (length + room + 1)) - 1)).bit_length() - 1
            if better > length:
                items[place] = by_length[better].pop()
                if not by_length[better]:
                    there ^= 1 << better
                    del by_length[better]
                by_length.setdefault(length, []).append(item)
                there |= 1 << length
                room -= better - length
                if not room:
                    break
        bins.room[which] = room
    return [item for items in by_length.values() for item in items]


def _repaired(kept: list[tuple[list[int], int]], loose: list[int], lengths: list[int], size: int) -> Bins:
    child = Bins(lengths, size)
    child.items, child.room = [list(items) for items, _ in kept], [room for _, room in kept]
    loose = _exchanged(child, loose)
    whole = Bins(lengths, size)
    for items, room in zip(child.items, child.room, strict=True):
        whole.add_bin(items, room)
    whole.best_fit(loose)
    return whole


def crossover(into: Bins, donor: Bins, rng: np.random.Generator, share: float = 0.5) -> Bins:
    """Injects well-filled bins of the donor whole, drops bins that share pieces with them, places what was displaced."""
    order = sorted(range(len(donor.items)), key=donor.room.__getitem__)
    best = order[: max(1, len(order) * 2 // 3)]
    take = rng.choice(len(best), max(1, int(len(best) * share * rng.random())), replace=False)
    kept, injected = [], set()
    for at in take.tolist():
        kept.append((donor.items[best[at]], donor.room[best[at]]))
        injected.update(donor.items[best[at]])
    loose = []
    for items, room in zip(into.items, into.room, strict=True):
        if injected.isdisjoint(items):
            kept.append((items, room))
        else:
            loose += [i for i in items if i not in injected]
    return _repaired(kept, loose, into.lengths, into.size)


def mutated(bins: Bins, rng: np.random.Generator, share: float = 0.05) -> Bins:
    """Opens the emptiest bins and a random few, and places their pieces anew."""
    order = sorted(range(len(bins.items)), key=lambda b: -bins.room[b])
    opened = {*order[: int(rng.integers(1, 4))], *rng.choice(len(order), max(1, int(len(order) * share)), replace=False).tolist()}
    kept = [(bins.items[b], bins.room[b]) for b in range(len(order)) if b not in opened]
    return _repaired(kept, [i for b in sorted(opened) for i in bins.items[b]], bins.lengths, bins.size)


def evolve(lengths: list[int], size: int, seed: int, elites: list[list[int]] = (), population: int = POPULATION, effort: int = EFFORT) -> Bins:
    """The best packing found. Elites are bin numbers per item. Ends at once where the lower bound is reached."""
    rng, least = np.random.default_rng(seed), lower_bound(lengths, size)
    people = []
    for elite in elites:
        grouped: dict[int, list[int]] = {}
        for item, which in enumerate(elite):
            grouped.setdefault(which, []).append(item)
        people.append(Bins(lengths, size))
        for items in grouped.values():
            people[-1].add_bin(items, size - sum(lengths[i] for i in items))
    if not people:
        people.append(Bins(lengths, size))
        people[0].best_fit(list(range(len(lengths))))
    best = min(people, key=Bins.fitness)
    population = max(population, min(5 * population, 2_000 // max(1, len(lengths))))
    while len(best.items) > least and len(people) < population:
        people.append(filled(lengths, size, rng))
        best = min(best, people[-1], key=Bins.fitness)
    for _ in range(min(MOST_GENERATIONS, max(4, effort // max(1, len(lengths))))):
        if len(best.items) <= least or len(lengths) < 2:
            break
        mother, father = rng.choice(len(people), 2, replace=False)
        if people[father].fitness() < people[mother].fitness():
            mother, father = father, mother
        # The fitter parent gives the well-filled bins.
        child = crossover(people[father], people[mother], rng)
        if rng.random() < 0.7:
            child = mutated(child, rng)
        # A child as fit as the better parent is most likely its copy: a newcomer keeps the population varied.
        people[father] = filled(lengths, size, rng) if child.fitness() == people[mother].fitness() else child
        best = min(best, child, key=Bins.fitness)
    return best


def _genome(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for which, items in enumerate(bins.items):
        for item in items:
            out[item] = which
    return out


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, keep: tuple[str, ...] = ("doc_id",), column: str = "text", problem: int = PROBLEM, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """One row per piece: kept columns, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows and repeated ids are documents of their own. An empty
    table gives an empty result; names of other columns do not matter. No task holds more than one
    problem's pieces, and a problem's size does not grow with the input.
    """
    pieces = settled(tokenised(lean(docs), path, size, end_id, keep, column))
    names = [*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "piece", "start", "length", "ids_crc32"]
    short = pieces.where(F.col("length") < size)
    problems = max(1, -(-short.count() // problem))
    short = short.withColumn("problem", F.pmod(F.xxhash64("row"), F.lit(problems)).cast("int"))
    items = short.select("problem", "row", "length").withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))

    def solve(key: tuple, rows: pa.Table, elites: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows:
            group, island = (k.as_py() for k in key)
            lengths = rows.sort_by("row").column("length").to_pylist()
            best = evolve(lengths, size, group * 1000 + island * 10 + elites.num_rows, elites.column("genome").to_pylist())
            found.append((group, island, *best.fitness(), _genome(best, len(lengths))))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
        return pa.table([pa.array([f[c] for f in found], kind) for c, kind in enumerate(kinds)], names=["problem", "island", "bins", "spread", "genome"])

    schema = "problem int, island int, bins long, spread long, genome array<int>"
    elites = docs.sparkSession.createDataFrame([], schema)
    for _ in range(epochs):
        found = items.groupBy("problem", "island").cogroup(elites.groupBy("problem", "island")).applyInArrow(solve, schema)
        found = settled(found)
        # The elite stays on its island and moves on to the next.
        elites = found.unionByName(found.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")))
    best = found.groupBy("problem").agg(F.min_by("genome", F.struct("bins", "spread", "island")).alias("genome"))
    columns = [f.name for f in short.schema.fields if f.name not in ("problem", "row")]

    def place(rows: pa.Table, genomes: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        bins = np.array(genomes.column("genome").combine_chunks().flatten(), np.int64) if rows.num_rows else np.zeros(0, np.int64)
        order, length = np.argsort(bins, kind="stable"), np.array(rows.column("length"), np.int64)
        ends = np.cumsum(length[order])
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])[: len(bins)]
        offsets = np.empty(len(bins), np.int64)
        offsets[order] = ends - length[order] - np.repeat((ends - length[order])[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
        numbers = np.array(rows.column("problem"), np.int64) * (4 * problem + 64) * 64 + bins
        return rows.select(columns).append_column("sequence_id", pa.array(numbers)).append_column("offset", pa.array(offsets))

    placed_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in short.select(*columns).schema.fields)
    placed = short.groupBy("problem").cogroup(best.groupBy("problem")).applyInArrow(place, f"{placed_schema}, sequence_id long, offset long")
    full = pieces.where(F.col("length") >= size).select(*columns, (-F.col("row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(full).select(*names, "sequence_id", "offset")
