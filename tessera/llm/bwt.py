"""Burrows-Wheeler transform and common prefixes of many short texts, built column by column.

Round j puts the suffix of length j of every text into the sorted list of all suffixes
so far: one symbol per text. The list is held as sequences that every round reads and
rewrites from front to back: the symbol before each suffix (the transform), the length
of the prefix that it shares with the suffix before it, and its text. The place of a
new suffix is the number of smaller symbols plus the number of equal symbols before
its tail; its common prefixes with its neighbours are one more than the least common
prefix between the tails.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Collection:
    """All suffixes in order: their text, their length, and the prefix shared with the one before."""

    text: np.ndarray
    size: np.ndarray
    common: np.ndarray
    symbol: np.ndarray


class _RangeMin:
    """Least values of ranges: a row per power of two, all in one array."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        rows = max(1, self.n.bit_length())
        self.flat = np.empty(rows * self.n, x.dtype)
        self.flat[:self.n] = x
        held, span = self.flat[:self.n], 1
        for k in range(1, rows):
            row, fit = self.flat[k * self.n:(k + 1) * self.n], self.n - 2 * span + 1
            np.minimum(held[:fit], held[span:span + fit], out=row[:fit])
            held, span = row, span * 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Least value between two places, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1].astype(np.int64) - 1
        row = level * self.n
        return np.minimum(self.flat[row + first], self.flat[row + last + 1 - (np.int64(1) << level)])


def build(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> Collection:
    """Transform and common prefixes of the texts ``data[start:start+size]`` (at most 250 bytes each).

    Equal suffixes stand in the order of their texts. At most 255 different byte
    values may occur (UTF-8 has fewer).
    """
    m = len(start)
    if m and size.max() > 250:
        raise ValueError("build: texts of at most 250 bytes")
    rank = np.zeros(256, np.uint8)
    values = np.unique(data)
    rank[values.astype(np.int64)] = np.arange(1, len(values) + 1)
    coded, end = np.r_[rank[data], np.uint8(0)], start + size - 1

    def before(texts: np.ndarray, j: int) -> np.ndarray:
        """The symbol before each text's suffix of length j; 0 where the text is complete."""
        return coded[np.where(size[texts] > j, end[texts] - j, len(data))]

    text = np.arange(m, dtype=np.int32)
    symbol, common, depth = before(text, 0), np.zeros(m, np.uint8), np.zeros(m, np.uint8)
    fresh = symbol > 0  # the last round's suffixes whose text goes on
    for j in range(1, int(size.max(initial=0)) + 1):
        order = np.argsort(symbol, kind="stable")
        done = len(symbol) - int(np.count_nonzero(symbol))
        at = np.flatnonzero(fresh[order])
        tails = order[at]
        going = text[tails]
        spots = m + at - done
        least = _RangeMin(common)
        c = symbol[tails]
        prev, after = order[at - 1], order[np.minimum(at + 1, len(order) - 1)]
        same = np.flatnonzero((at > 0) & (symbol[prev] == c))
        follows = np.flatnonzero((at + 1 < len(order)) & (symbol[after] == c))
        shared = 1 + least(np.r_[prev[same], tails[follows]] + 1, np.r_[tails[same], after[follows]])
        above = np.zeros(len(at), np.uint8)
        above[same] = shared[:len(same)]
        total = len(symbol) + len(going)
        fresh = np.zeros(total, bool)
        fresh[spots] = True
        old = ~fresh

        def rewrite(held: np.ndarray, new) -> np.ndarray:
            out = np.empty(total, held.dtype)
            out[old] = held
            out[spots] = new
            return out

        new = before(going, j)
        symbol, text = rewrite(symbol, new), rewrite(text, going)
        depth, common = rewrite(depth, j), rewrite(common, above)
        common[spots[follows] + 1] = shared[len(same):]
        fresh[spots] = new > 0
    return Collection(text, depth, common, symbol)
