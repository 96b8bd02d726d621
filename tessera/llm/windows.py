"""Windows of fixed byte length, and the anchor (minimizer) that each window chooses.

Every window of ``length`` bytes picks the ``gram``-byte run with the smallest hash in
it, the first of equal ones. The choice depends on the window's bytes alone, so equal
windows in different texts pick equal anchors, and an anchor serves a run of
neighbouring windows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .common import mix64
from .tokens import hash_spans, running

GRAM = 24
_PLACE = np.uint64((1 << 24) - 1)


@dataclass
class Anchors:
    """Runs of windows with a common anchor, in the order of the text's bytes.

    ``text``: index of the text; ``first`` and ``last``: the run's window starts in
    ``data``; ``hash``: of the anchor's bytes; ``content``: of all bytes of the run and
    the anchor's place in it.
    """

    data: np.ndarray
    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray
    content: np.ndarray
    length: int

    def windows(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(run, start)`` of all windows of the chosen runs."""
        size = self.last[some] - self.first[some] + 1
        run = np.repeat(some, size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return run, self.first[run] + within

    def window_hashes(self, start: np.ndarray) -> np.ndarray:
        return mix64(hash_spans(self.data, start, start + self.length))


def anchors(data: np.ndarray, off: np.ndarray, length: int = 50, gram: int = GRAM) -> Anchors:
    """Anchor runs of all windows inside the texts that lie end to end in ``data`` (at most 16 MB)."""
    if len(data) > int(_PLACE):
        raise ValueError("anchors: more than 16 MB at once")
    none = np.zeros(0, np.int64)
    width = length - gram + 1
    count = len(data) - length + 1
    if count <= 0:
        return Anchors(data, none, none, none, none.astype(np.uint64), none.astype(np.uint64), length)
    sums, inverse = running(data)
    n = len(data) - gram + 1
    grams = mix64((sums[gram:] - sums[:n]) * inverse[:n])
    low = grams & ~_PLACE
    low |= np.arange(n, dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    at = (low[:count] & _PLACE).astype(np.int64)
    # a run begins where the anchor changes or a text begins, and ends within its text
    size = np.maximum(0, np.diff(off) - length + 1)
    new = np.r_[True, at[1:] != at[:-1]]
    new[off[:-1][size > 0]] = True
    begin = np.nonzero(new)[0]
    text = np.searchsorted(off, begin, side="right") - 1
    stop = off[text] + size[text]
    some = begin < stop
    first, last = begin[some], np.minimum(np.r_[begin[1:], count], stop)[some] - 1
    text, at = text[some], at[first]
    with np.errstate(over="ignore"):
        content = mix64((sums[last + length] - sums[first]) * inverse[first]
                        + (at - first).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return Anchors(data, text, first, last, grams[at], content, length)
