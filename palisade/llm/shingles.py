"""Hashed words and word shingles of many texts at once, from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20_240_229)
#: A random number per byte value (A-Z as a-z where lower-casing is asked for); white space counts nothing.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BYTE_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_CODES[SPACES] = 0
LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[ord("A") : ord("Z") + 1] = BYTE_CODES[ord("a") : ord("z") + 1]
BASE = np.uint64(0x9E3779B97F4A7C15)
PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """BASE to the power 0 .. n - 1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 256) - 1, BASE, np.uint64)]))
    return _powers[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(flat: np.ndarray, offsets: np.ndarray, codes: np.ndarray = LOWER_CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first byte, end byte, offsets by text) of the white-space separated words of all texts."""
    n = len(offsets) - 1
    solid = ~SPACES[flat]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flat))]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(first):
        return np.zeros(0, np.uint64), first, last, np.zeros(n + 1, np.int64)
    place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], first]), np.diff(np.concatenate([[0], first, [len(flat)]])))
    values = codes[flat] * powers(int(place.max()) + 1)[place]
    hashes = np.add.reduceat(values, first)
    return mixed(hashes + (last - first).astype(np.uint64)), first, last, np.searchsorted(first, offsets)


def shingles(flat: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles; a text with fewer words is one shingle, without words none."""
    hashes, _, _, by_text = words(flat, offsets)
    grams = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for at in range(width if len(grams) else 0):
        grams += hashes[at : at + len(grams)] * PLACES[at]
    grams = mixed(grams)
    out = []
    for lo, hi in zip(by_text[:-1].tolist(), by_text[1:].tolist(), strict=True):
        if hi - lo >= width:
            own = np.sort(grams[lo : hi - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
        elif hi > lo:
            own = hashes[lo:hi]
            out.append(mixed((own * PLACES[: hi - lo]).sum(keepdims=True) + np.array([hi - lo], np.uint64) * PLACES[63]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
