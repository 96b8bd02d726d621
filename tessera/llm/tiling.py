"""Benchmark decontamination by greedy string tiling.

Texts are sequences of words (letters and digits, lower-cased). Seeds are the runs
of ``MIN_MATCH`` words that a document shares with a benchmark item, found by running
Karp-Rabin hashes over word numbers and confirmed word by word. For every document
and item that share a seed, the longest match of unmarked words is marked, again and
again, until no match of ``MIN_MATCH`` words is left; the marked runs (tiles) do not
overlap in either text. An item whose words are covered to ``COVERAGE`` is in the
document, in whatever order its passages stand there.

The benchmark reaches the workers in blocks of bounded size, one pass over the
documents each; documents are never joined or moved.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, cut

MIN_MATCH = 4
COVERAGE = 0.7
BLOCK_BYTES = 32 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def running_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin hash modulo 2**64 of every run of ``width`` word numbers."""
    count = len(ids) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * FACTOR + x[k:k + count]
    return out


class Benchmark:
    """Word numbers of a block of items, and where every seed starts."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int):
        self.min_match = min_match
        self.ids = [i for i, _ in items]
        self.vocab: dict[str, int] = {}
        self.items = [np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words_of(t)], np.int64) for _, t in items]
        hashes = [running_hashes(x, min_match) for x in self.items]
        item = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.short = [k for k, x in enumerate(self.items) if 0 < len(x) < min_match]
        self.seed, self.item, self.place = every[order], item[order], place[order]

    def numbers(self, text: str) -> np.ndarray:
        """Word numbers of a document; words that no item has are -1."""
        get = self.vocab.get
        return np.array([get(w, -1) for w in words_of(text)], np.int64)

    def windows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(order, first, lo, hi)``: places of the document's windows that are a seed, by seed; where each
        distinct seed begins in them; and its entries in the benchmark."""
        none = (np.zeros(0, np.int64),) * 4
        if len(ids) < self.min_match or len(self.seed) == 0:
            return none
        unknown = np.r_[0, np.cumsum(ids < 0)]
        at = np.nonzero(unknown[self.min_match:] == unknown[:-self.min_match])[0]
        if len(at) == 0:
            return none
        h = running_hashes(ids, self.min_match)[at]
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        first = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0]
        lo, hi = (np.searchsorted(self.seed, h[first], side=s) for s in ("left", "right"))
        return at, np.r_[first, len(at)], lo, hi

    def pairs(self, ids: np.ndarray, item: int, at: np.ndarray, first: np.ndarray, which: np.ndarray,
              q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places ``(document, item)`` where one item's seeds start, confirmed word by word: entry
        ``q[k]`` with every window of seed ``which[k]``."""
        n = first[which + 1] - first[which]
        p = at[np.repeat(first[which] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        q, words = np.repeat(q, n), self.items[item]
        same = np.ones(len(p), bool)
        for k in range(self.min_match):
            same &= ids[p + k] == words[q + k]
        return p[same], q[same]

    def seeds(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(item, place in the document, place in the item)`` of all shared seeds."""
        at, first, lo, hi = self.windows(ids)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        entry = np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo) + np.arange(len(which)) if len(lo) else which
        out = []
        for i in np.unique(self.item[entry]).tolist():
            mine = self.item[entry] == i
            p, q = self.pairs(ids, i, at, first, which[mine], self.place[entry[mine]])
            out.append((np.full(len(p), i), p, q))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def whole(self, ids: np.ndarray, item: int, starts: np.ndarray) -> int:
        """The first of the places ``starts`` where the document holds the item whole, or -1."""
        words = self.items[item]
        starts = starts[starts + len(words) <= len(ids)]
        for s in range(0, len(starts), 256):
            some = starts[s:s + 256]
            fits = np.ones(len(some), bool)
            for k in range(len(words)):
                fits &= ids[some + k] == words[k]
                if not fits.any():
                    break
            if fits.any():
                return int(some[fits][0])
        return -1


def tile(p: np.ndarray, q: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(place in the document, place in the item, words)`` from the shared seeds of one pair.

    The longest match comes first; of equal ones the first in the item, then in the
    document. Seeds that touch a marked word are gone, so what is left of a match
    that overlaps a tile competes again with its remaining length.
    """
    out = []
    while len(p):
        order = np.lexsort((p, p - q))
        p, q = p[order], q[order]
        new = np.r_[True, (np.diff(p - q) != 0) | (np.diff(p) != 1)]
        start = np.nonzero(new)[0]
        size = np.diff(np.r_[start, len(p)])
        best = np.lexsort((p[start], q[start], -size))[0]
        a, b, n = int(p[start[best]]), int(q[start[best]]), int(size[best]) + min_match - 1
        out.append((a, b, n))
        free = ((p + min_match <= a) | (p >= a + n)) & ((q + min_match <= b) | (q >= b + n))
        p, q = p[free], q[free]
    return out


def covered(bench: Benchmark, text: str, coverage: float) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """``(item, tiles)`` of the items that a document covers to ``coverage``.

    Items are judged one after the other, first by the distinct seeds alone: no tiling covers
    more words than they do. An item that stands whole in the document is one tile, the first
    place of it, as the greedy rule has it; so a text that repeats it a thousand times lists no
    pairs. Items of fewer than ``min_match`` words are looked for whole, and nothing else."""
    ids, out = bench.numbers(text), []
    for i in bench.short:
        found = bench.whole(ids, i, np.nonzero(ids == bench.items[i][0])[0])
        if found >= 0:
            out.append((i, [(found, 0, len(bench.items[i]))]))
    at, first, lo, hi = bench.windows(ids)
    if len(lo) == 0 or (hi == lo).all():
        return out
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    entry = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    items = bench.item[entry]
    order = np.argsort(items, kind="stable")
    edges = np.nonzero(np.r_[True, np.diff(items[order]) != 0, True])[0]
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
        mine = order[s:e]
        i, seeds, q = int(items[mine[0]]), which[mine], bench.place[entry[mine]]
        need = coverage * len(bench.items[i])
        reach = np.zeros(len(bench.items[i]), bool)
        for k in range(bench.min_match):
            reach[q + k] = True
        if reach.sum() < need:
            continue
        head = seeds[q == 0]
        place = bench.whole(ids, i, at[first[head[0]]:first[head[0] + 1]]) if len(head) and reach.all() else -1
        tiles = [(place, 0, len(bench.items[i]))] if place >= 0 else tile(*bench.pairs(ids, i, at, first, seeds, q), bench.min_match)
        if sum(t[2] for t in tiles) >= need:
            out.append((i, tiles))
    return sorted(out)


def _blocks(benchmark: DataFrame, min_match: int, item_col: str, text_col: str) -> list:
    """The benchmark as broadcasts of about ``BLOCK_BYTES`` of text each."""
    spark = benchmark.sparkSession
    src = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        "text is not null")
    volume = src.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-volume // BLOCK_BYTES))
    dealt = src.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    dealt = dealt if n == 1 else cut(dealt, "tiling-benchmark")
    for k in range(n):
        rows = dealt.where(F.col("block") == k).collect()
        yield spark.sparkContext.broadcast(Benchmark(sorted((r.id, r.text) for r in rows if r.id is not None)
                                                     + [(None, r.text) for r in rows if r.id is None], min_match))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(doc_id, item_id, item_words, covered, coverage, tiles)`` for documents that hold a benchmark item.

    One row per document row and item whose share of covered words is at least
    ``coverage``; clean documents give none. ``tiles``: array of (doc_word, item_word,
    words). Items of fewer than ``min_match`` words match where a document holds all their
    words in a row; null and empty texts, and items without a word, match nothing; null ids come back as null; repeated rows give repeated results. Empty
    tables give an empty result; other columns are ignored.
    """
    target = ("doc_id long, item_id long, item_words long, covered long, coverage double, "
              "tiles array<struct<doc_word:long,item_word:long,words:long>>")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tiles_type = pa.list_(pa.struct([("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())]))

    def finder(held):
        def run(batches):
            bench = held.value
            for b in batches:
                ids, rows = b.column(0).to_pylist(), []
                for i, text in zip(ids, byte_rows(b, "text")):
                    for item, tiles in covered(bench, text.decode("utf-8", "replace"), coverage):
                        n, done = len(bench.items[item]), sum(t[2] for t in tiles)
                        rows.append((i, bench.ids[item], n, done, done / n,
                                     [dict(zip(("doc_word", "item_word", "words"), t)) for t in tiles]))
                cols = list(zip(*rows)) if rows else [[]] * 6
                kinds = [pa.int64()] * 4 + [pa.float64(), tiles_type]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                                 ["doc_id", "item_id", "item_words", "covered", "coverage", "tiles"])
        return run

    out = None
    for held in _blocks(benchmark, min_match, item_col, "text"):
        part = src.mapInArrow(finder(held), target)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                      text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item; see ``contaminated``."""

    def keeper(held):
        def run(batches):
            bench = held.value
            for b in batches:
                clean = [not covered(bench, t.decode("utf-8", "replace"), coverage) for t in byte_rows(b, text_col)]
                yield b.filter(pa.array(clean, pa.bool_()))
        return run

    for held in _blocks(benchmark, min_match, item_col, "text"):
        docs = docs.mapInArrow(keeper(held), docs.schema)
    return docs
