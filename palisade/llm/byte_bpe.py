"""Byte-level BPE in linear time: Aho-Corasick matches, backtracking over compatible neighbours.

Bytes are mapped one to one to Latin-1 characters, so that pyahocorasick, which matches text, finds every
vocabulary entry in a piece. The encoder takes the longest entry at each place and keeps it if
it may stand after the last token; otherwise it tries the next shorter prefix, and steps back when
there is none. Two tokens may be neighbours if merging their joined bytes would never have fused
across the border; this is memoised per pair. The result is exactly that of merging by rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import frugal, lean, text_slices

#: Remembered pieces per worker, and letters of the longest; beyond it the memory is cleared (results do not depend on it).
PIECE_CACHE, PIECE_LETTERS = 700_000, 40
PAIR_CACHE = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


def unicode_spaces(pattern: str) -> str:
    """The pattern with white space as Unicode defines it, which is what the rank files' pattern means."""
    return pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class ByteBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pieces = regex.compile(unicode_spaces(pattern))
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        #: Ids of pieces seen by this worker, over all its tasks.
        self.memory: dict[str, list[int]] = {}
        self.trie = ahocorasick.Automaton()
        reachable = []
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                reachable.append((token, rank))
                continue
            parts = self._last_two(token, rank)
            if parts is not None:
                self.halves[rank] = parts
                self.merged[parts] = rank
                reachable.append((token, rank))
        known = {token: rank for token, rank in reachable}
        for token, rank in reachable:
            self.trie.add_word(token.decode("latin-1"), (len(token) - 1, rank, len(token)))
            for size in range(len(token) - 1, 0, -1):
                if (prefix := known.get(token[:size])) is not None:
                    self.shorter[rank] = prefix
                    break
        self.trie.make_automaton()
        self.sizes = {rank: len(token) for token, rank in reachable}

    def _last_two(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens that merging by rank fuses last, or None if it never reaches the token."""
        ranks = self.ranks
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for i in range(len(parts) - 1):
                if (r := ranks.get(parts[i] + parts[i + 1], rank)) < best:
                    best, at = r, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return ranks[parts[0]], ranks[parts[1]]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves these two tokens apart when they stand side by side."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIR_CACHE:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        # Undo merges on both sides of the border, latest first; a merge across the border that would
        # have come before the merge undone last contradicts the pair.
        merged, halves = self.merged, self.halves
        bound = 1 << 62
        while True:
            across = merged.get((left, right))
            if across is not None and across < bound:
                return False
            # The higher rank was merged later; of equal ranks the left one was merged first.
            if left > right and left in halves:
                bound, left = left, halves[left][1]
            elif right in halves and not (left > right):
                bound, right = right + 1, halves[right][0]
            elif left in halves and (right not in halves):
                bound, left = left, halves[left][1]
            elif right in halves and (left not in halves):
                bound, right = right + 1, halves[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        end = len(piece)
        longest = [0] * end
        for last, (back, rank, _) in self.trie.iter(piece.decode("latin-1")):
            longest[last - back] = rank
        sizes, shorter, neighbours = self.sizes, self.shorter, self.neighbours
        open_at = bytearray(b"\1") * (end + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            stop = at + sizes[token]
            if open_at[stop] and (not out or neighbours(out[-1], token)):
                out.append(token)
                if stop == end:
                    return out
                at, token = stop, longest[stop]
                continue
            less = shorter.get(token)
            while less is None:
                # No token fits here: this place cannot be reached, go one token back and shorten it.
                open_at[at] = 0
                token = out.pop()
                at -= sizes[token]
                less = shorter.get(token)
            token = less

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for piece in self.pieces.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


_loaded: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str) -> ByteBpe:
    """One coder per worker and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(read_ranks(path), pattern)
    return _loaded[path, pattern]


def coded(coder: ByteBpe, texts: Iterator[str], memory: dict[str, list[int]]) -> Iterator[list[int]]:
    """Ids of each text; pieces seen before come from the memory."""
    find, encode_piece = coder.pieces.findall, coder.encode_piece
    for text in texts:
        ids: list[int] = []
        for piece in find(text):
            known = memory.get(piece)
            if known is None:
                known = encode_piece(piece.encode())
                if len(piece) <= PIECE_LETTERS:
                    if len(memory) >= PIECE_CACHE:
                        memory.clear()
                    memory[piece] = known
            ids += known
        yield ids


def encode_texts(docs: DataFrame, path: str, pattern: str, column: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The kept columns and `ids` array<int>, `decoded` binary of each row's text.

    Null and empty texts have no ids and decode to nothing. Repeated rows stay. The vocabulary's path
    is a parameter; every executor reads it there. Names of other columns do not matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(path, pattern)
        for batch in batches:
            for first, last, texts in text_slices(batch.column(len(keep))):
                part = batch.slice(first, last - first)
                found = list(coded(coder, texts, coder.memory))
                columns = [part.column(i) for i in range(len(keep))]
                columns += [pa.array(found, pa.list_(pa.int32())), pa.array([coder.decode(x) for x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"])

    source = lean(docs).select(*keep, F.col(column).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(frugal(work), f"{schema}, ids array<int>, decoded binary")
