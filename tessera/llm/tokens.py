"""Vectorised words of UTF-8 texts: A-Z lower-cased, split at ASCII white space, hashed to 64 bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from .common import seeded

CHUNK = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTOR = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2**64 and of its inverse."""
    inverse = pow(FACTOR, -1, 1 << 64)
    out = []
    with np.errstate(over="ignore"):
        for base in (FACTOR, inverse):
            p = np.full(size + 1, np.uint64(base), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_LETTERS = seeded(256, 11)


def running(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of a random word per byte value times a power of its place, and the powers' inverses."""
    power, inverse = _powers(max(CHUNK, 1 << int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_LETTERS[data] * power[:len(data)], out=sums[1:])
    return sums, inverse


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every span of bytes, from the sums before its two ends."""
    sums, inverse = running(data)
    with np.errstate(over="ignore"):
        return (sums[end] - sums[start]) * inverse[start]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, start, end, text)`` of the words of texts that lie end to end in ``data``."""
    if len(data) == 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    inside = ~SPACE[data]
    border = np.zeros(len(data) + 1, bool)
    border[off] = True
    before = np.r_[False, inside[:-1]] & ~border[:-1]
    after = np.r_[inside[1:], False] & ~border[1:]
    start = np.nonzero(inside & ~before)[0]
    end = np.nonzero(inside & ~after)[0] + 1
    return hash_spans(LOWER[data], start, end), start, end, np.searchsorted(off, start, side="right") - 1


def chunks(data: np.ndarray, off: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs ``(first, last, data, offsets)`` of whole texts of about ``size`` bytes (one text at least)."""
    n, s = len(off) - 1, 0
    while s < n:
        e = max(s + 1, int(np.searchsorted(off, off[s] + size, side="right")) - 1)
        yield s, e, data[off[s]:off[e]], off[s:e + 1] - off[s]
        s = e
