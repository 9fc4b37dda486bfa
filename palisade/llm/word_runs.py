"""Words of letters and digits in many texts at once, from their UTF-8 bytes, and checksums of byte slices."""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters and everything outside ASCII.
WORD = np.zeros(256, bool)
WORD[ord("0") : ord("9") + 1] = WORD[ord("a") : ord("z") + 1] = WORD[ord("A") : ord("Z") + 1] = WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Slices up to so many bytes are checked in step, all at once; longer ones one by one.
STEPS = 48


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def word_runs(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, offsets by text) of the words of all texts; no word crosses from text to text."""
    solid = WORD[flat]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flat))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(ends) + 1, np.searchsorted(first, offsets)


def joined_words(flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after the other, lower-cased, a space before each and one at the end; their first and end bytes there."""
    lengths = last - first
    begin = np.cumsum(np.concatenate([[0], lengths[:-1] + 1])) + 1 if len(first) else first
    out = np.full(int(lengths.sum()) + len(first) + 1, ord(" "), np.uint8)
    step = np.repeat(first - begin, lengths)
    where = np.arange(len(step)) + np.repeat(begin - np.cumsum(lengths) + lengths, lengths)
    out[where] = LOWER[flat[where + step]]
    return out, begin, begin + lengths


def crc32_slices(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The unsigned crc32 of every slice."""
    lengths = last - first
    order = np.argsort(-lengths, kind="stable")
    longer = int(np.count_nonzero(lengths > STEPS))
    starts, sizes = first[order], lengths[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
    for step in range(int(sizes[longer]) if len(sizes) > longer else 0):
        end = longer + int(np.searchsorted(-sizes[longer:], -step, "left"))
        own = crc[longer:end]
        crc[longer:end] = CRC[(own ^ data[starts[longer:end] + step]) & np.uint32(255)] ^ (own >> np.uint32(8))
    crc = ~crc
    for at in range(longer):
        crc[at] = zlib.crc32(data[starts[at] : starts[at] + sizes[at]].tobytes())
    out = np.empty(len(order), np.uint32)
    out[order] = crc
    return out
