"""Removal of repeated runs of words with suffix trees that are built one prefix group at a time.

A word goes if a window of ``length`` words that covers it also starts in a document with
a smaller id. Documents lie in chunks of bounded size, written once as a table bucketed by
chunk, and only packed rows move.

1. Prefixes. Every window chooses the ``PREFIX``-word prefix with the smallest hash among
   those that start inside it, so equal windows choose equal prefixes, and a prefix serves a
   run of neighbouring windows. Chunks send their distinct prefixes with the number of
   different runs below each; a group of prefixes adds up. A prefix of one document only
   cannot lead to a repeat and is pruned. A prefix with more runs than ``group_runs`` is
   too heavy for one group: its windows get the longest prefix instead, all their words.
2. Subtrees. The suffixes below the prefixes of a group, the words of the runs that
   serve them, are sorted, and common prefixes of neighbours give the subtree's internal
   nodes. A node ``length`` words deep or deeper holds the places of a repeat; its smallest
   document goes back to the chunks, one bit per window. Deeper levels than ``length``
   change no answer and are not built.

The number of groups follows from the runs that survive, so a group stays of bounded size;
a passage that every document holds is one run per chunk. Words are compared by 64-bit
hashes, place by place over the whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, utf8_column
from .exchange import PACKED, answered, bucket_of, chunk_table, decoded, merged, packed_rows
from .tokens import SPACE, hash_spans

LENGTH = 13         # words in a window
PREFIX = 4          # words in a prefix
SLICE = 1 << 20     # bytes hashed at once
WORDS = 1 << 18     # words whose windows choose their prefixes at once
GROUP_BYTES = 8 << 20  # text bytes per group of prefixes
MIN_GROUPS = 64
GROUP_RUNS = 1 << 16  # runs below one prefix before its windows get longer ones
NO_ID = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text)`` of the words of texts that lie end to end, unchanged, in slices cut at white space."""
    hashes, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    a = 0
    while a < len(data):
        z = min(a + SLICE, len(data))
        while z < len(data):  # never cut inside a word
            ahead = np.nonzero(SPACE[data[z:z + SLICE]])[0]
            z = z + int(ahead[0]) if len(ahead) else min(z + SLICE, len(data))
            if len(ahead):
                break
        part = data[a:z]
        inside = ~SPACE[part]
        border = np.zeros(len(part) + 1, bool)
        mine = off[np.searchsorted(off, a):np.searchsorted(off, z, side="right")]
        border[mine - a] = True
        start = np.nonzero(inside & ~(np.r_[False, inside[:-1]] & ~border[:-1]))[0]
        end = np.nonzero(inside & ~(np.r_[inside[1:], False] & ~border[1:]))[0] + 1
        hashes.append(mix64(hash_spans(part, start, end)))
        texts.append(np.searchsorted(off, start + a, side="right") - 1)
        a = z
    return np.concatenate(hashes), np.concatenate(texts)


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2**64 and of its inverse."""
    out = []
    for base in (0x9FB21C651E98DF25, pow(0x9FB21C651E98DF25, -1, 1 << 64)):
        p = np.full(size, np.uint64(base), np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def prefix_runs(words: np.ndarray, text: np.ndarray, length: int, prefix: int) -> tuple[np.ndarray, ...]:
    """``(first, last, hash, content)``: runs of windows (by their first words) that chose one
    prefix, its hash, and a hash of all words of the run."""
    width = length - prefix + 1
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    power, inverse = _powers(WORDS + length)
    place = np.uint64((1 << 20) - 1)
    for s in range(0, max(0, len(words) - length + 1), WORDS):
        w, t = words[s:s + WORDS + length - 1], text[s:s + WORDS + length - 1]
        start = np.nonzero(t[:len(w) - length + 1] == t[length - 1:])[0]
        if len(start) == 0:
            continue
        sums = np.zeros(len(w) + 1, np.uint64)
        np.cumsum(w * power[:len(w)], out=sums[1:])
        gram = mix64((sums[prefix:] - sums[:-prefix]) * inverse[:len(w) - prefix + 1])
        low = gram & ~place | np.arange(len(gram), dtype=np.uint64)
        span = 1
        while span * 2 <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
        at = (low[start] & place).astype(np.int64)
        new = np.nonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])[0]
        first, last = start[new], start[np.r_[new[1:], len(start)] - 1]
        content = mix64((sums[last + length] - sums[first]) * inverse[first])
        # chosen hashes are small ones: mixed again, they spread evenly over the groups
        out.append((first + s, last + s, mix64(gram[at[new]] ^ _LOW), content))
    return tuple(np.concatenate(c) for c in zip(*out))


def _edges(sorted_values: np.ndarray) -> np.ndarray:
    """Where equal values begin, and the end."""
    if len(sorted_values) == 0:
        return np.zeros(1, np.int64)
    return np.r_[np.nonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])[0], len(sorted_values)]


def _spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of each entry, end to end."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Chunk:
    """The rows of a chunk, their words, and the runs of windows below each prefix."""

    def __init__(self, blob: bytes, text_at: int, length: int, prefix: int):
        self.batch, self.length = decoded(blob), length
        self.data, self.off = utf8_column(self.batch, self.batch.schema.names[text_at])
        self.ids = self.batch.column(self.batch.num_columns - 1).to_numpy()
        self.words, self.text = word_spans(self.data, self.off)
        self.first, self.last, self.hash, self.content = prefix_runs(self.words, self.text, length, prefix)

    def cut_key(self, groups: int) -> np.ndarray:
        """Group and 32 bits of each run's prefix; prefixes that fall together are told apart later."""
        return bucket_of(self.hash, groups) << np.uint64(32) | self.hash & _LOW

    def owner(self, first: np.ndarray) -> np.ndarray:
        return self.ids[self.text[first]]


@dataclass
class Entries:
    """Distinct runs of a chunk that may repeat, in the order in which they are sent.

    ``first``, ``last``, ``key``: all runs, by key, words and document; ``edge``: where a
    new distinct run begins; ``low``: its smallest document; ``group``: of its prefix.
    """

    first: np.ndarray
    last: np.ndarray
    doc: np.ndarray
    edge: np.ndarray
    low: np.ndarray
    group: np.ndarray

    def groups(self) -> Iterator[tuple[int, int, int]]:
        e = _edges(self.group)
        yield from ((int(self.group[s]), s, z) for s, z in zip(e[:-1].tolist(), e[1:].tolist()))


def _send_prefixes(c: Chunk, chunk: int, groups: int) -> pa.Table:
    key = c.cut_key(groups)
    doc = c.owner(c.first)
    order = np.lexsort((c.content, key))
    k, content, doc = key[order], c.content[order], doc[order]
    edge = _edges(k)
    if len(k) == 0:
        return packed_rows(chunk, [])
    several = np.minimum.reduceat(doc, edge[:-1]) != np.maximum.reduceat(doc, edge[:-1])
    new = np.r_[True, (k[1:] != k[:-1]) | (content[1:] != content[:-1])]
    runs = np.minimum(np.add.reduceat(new.astype(np.int64), edge[:-1]), 65535).astype("<u2")
    k = k[edge[:-1]]
    at = _edges(k >> np.uint64(32))
    return packed_rows(chunk, [(int(k[s] >> np.uint64(32)), (k[s:e] & _LOW).astype("<u4").tobytes(),
                                np.packbits(several[s:e]).tobytes(), runs[s:e].tobytes())
                               for s, e in zip(at[:-1].tolist(), at[1:].tolist())])


def _merge_prefixes(rows: pa.Table, group_runs: int) -> pa.Table:
    """To each chunk: its prefixes that lead to more than one document, and which are too heavy for one group."""
    keys = [np.frombuffer(k, "<u4") for k in rows.column("keys").to_pylist()]
    several = [np.unpackbits(np.frombuffer(a, np.uint8))[:len(k)] for a, k in zip(rows.column("a").to_pylist(), keys)]
    runs = np.concatenate([np.frombuffer(b, "<u2") for b in rows.column("b").to_pylist()])
    _, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    more = ((count > 1) | (np.bincount(at, np.concatenate(several)) > 0))[at]
    heavy = (np.bincount(at, runs) > group_runs)[at]
    out, s = [], 0
    group = rows.column("bucket")[0].as_py()
    for chunk, k in zip(rows.column("chunk").to_pylist(), keys):
        mine = more[s:s + len(k)]
        if mine.any():
            out.append(packed_rows(chunk, [(group, k[mine].tobytes(), np.packbits(heavy[s:s + len(k)][mine]).tobytes(), b"")]))
        s += len(k)
    return pa.concat_tables(out) if out else packed_rows(0, [])


def _entries(c: Chunk, replies: pa.Table, groups: int) -> Entries:
    """The chunk's distinct runs below prefixes of several documents; below heavy ones, single windows."""
    known, heavy = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    for group, k, a in zip(*(replies.column(n).to_pylist() for n in ("bucket", "keys", "a"))):
        low = np.frombuffer(k, "<u4")
        known.append(np.uint64(group) << np.uint64(32) | low.astype(np.uint64))
        heavy.append(np.unpackbits(np.frombuffer(a, np.uint8))[:len(low)].astype(bool))
    known, heavy = np.concatenate(known), np.concatenate(heavy)
    order = np.argsort(known)
    known, heavy = known[order], heavy[order]
    key = c.cut_key(groups)
    at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
    hit = known[at] == key if len(known) else np.zeros(len(key), bool)
    long = hit & heavy[at] if len(known) else hit
    light = np.nonzero(hit & ~long)[0]
    long = np.nonzero(long)[0]
    first = _spread(c.first[long], c.last[long] - c.first[long] + 1)
    power, _ = _powers(WORDS + c.length)
    whole = np.zeros(len(first), np.uint64)
    for k in range(c.length):
        whole += c.words[first + k] * power[k]
    whole = mix64(whole)
    first, last = np.r_[c.first[light], first], np.r_[c.last[light], first]
    key, content = np.r_[c.hash[light], whole], np.r_[c.content[light], whole]
    doc = c.owner(first)
    order = np.lexsort((doc, content, key))
    key, content, doc = key[order], content[order], doc[order]
    edge = np.r_[np.nonzero(np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])])[0], len(key)] if len(key) else np.zeros(1, np.int64)
    return Entries(first[order], last[order], doc, edge, doc[edge[:-1]], bucket_of(key[edge[:-1]], groups).astype(np.int64))


def _send_suffixes(c: Chunk, chunk: int, replies: pa.Table, groups: int) -> pa.Table:
    """Per group, the distinct runs: smallest documents and window counts, and the words by a dictionary."""
    e = _entries(c, replies, groups)
    rows = []
    for group, s, z in e.groups():
        first, last = e.first[e.edge[s:z]], e.last[e.edge[s:z]]
        words = c.words[_spread(first, last - first + c.length)]
        names, code = np.unique(words, return_inverse=True)
        rows.append((group, e.low[s:z].astype("<i8").tobytes() + (last - first + 1).astype("<u2").tobytes(),
                     names.astype("<u8").tobytes(), code.astype("<u2" if len(names) <= 1 << 16 else "<u4").tobytes()))
    return packed_rows(chunk, rows)


def deep_nodes(words: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(order, node)``: suffixes sorted by their first ``length`` words, and for each the internal
    node (or leaf) of that depth it hangs from. ``words`` are ranks; ``start`` where suffixes begin."""
    bits = max(1, int(words.max(initial=0)).bit_length())
    step = max(1, 63 // bits)
    columns = []
    for k in range(0, length, step):
        packed = np.zeros(len(start), np.uint64)
        for j in range(k, min(k + step, length)):
            packed = packed << np.uint64(bits) | words[start + j].astype(np.uint64)
        columns.append(packed)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for packed in columns:
        p = packed[order]
        new[1:] |= p[1:] != p[:-1]
    return order, np.cumsum(new) - 1


def _merge_suffixes(rows: pa.Table, length: int) -> pa.Table:
    """The subtrees of a group; to each chunk, one bit per window sent: does it start in a smaller document?"""
    low, size, words = [], [], []
    for k, a, b in zip(*(rows.column(n).to_pylist() for n in ("keys", "a", "b"))):
        n = len(k) // 10
        low.append(np.frombuffer(k, "<i8", n))
        size.append(np.frombuffer(k, "<u2", n, 8 * n).astype(np.int64))
        names = np.frombuffer(a, "<u8")
        words.append(names[np.frombuffer(b, "<u2" if len(names) <= 1 << 16 else "<u4")])
    per_row = [int(s.sum()) for s in size]
    low, size, words = np.concatenate(low), np.concatenate(size), np.concatenate(words)
    _, words = np.unique(words, return_inverse=True)
    span = size + length - 1
    start = _spread(np.cumsum(span) - span, size)
    doc = np.repeat(low, size)
    order, node = deep_nodes(words, start, length)
    least = np.minimum.reduceat(doc[order], _edges(node)[:-1])
    less = np.zeros(len(start), bool)
    less[order] = least[node] < doc[order]
    out, s = [], 0
    group = rows.column("bucket")[0].as_py()
    for chunk, n in zip(rows.column("chunk").to_pylist(), per_row):
        mine = less[s:s + n]
        if mine.any():
            out.append(packed_rows(chunk, [(group, np.packbits(mine).tobytes(), b"", b"")]))
        s += n
    return pa.concat_tables(out) if out else packed_rows(0, [])


def _removed(c: Chunk, prefixes: pa.Table, verdicts: pa.Table, groups: int) -> np.ndarray:
    """Which words of the chunk's texts go."""
    e = _entries(c, prefixes, groups)
    bits = dict(zip(verdicts.column("bucket").to_pylist(), verdicts.column("keys").to_pylist()))
    size = (e.last - e.first + 1)[e.edge[:-1]]
    begin = np.r_[0, np.cumsum(size)]
    less = np.zeros(begin[-1], bool)
    for group, s, z in e.groups():
        if group in bits:
            less[begin[s]:begin[z]] = np.unpackbits(np.frombuffer(bits[group], np.uint8))[:begin[z] - begin[s]]
    entry = np.repeat(np.arange(len(size)), np.diff(e.edge))
    each = e.last - e.first + 1
    start = _spread(e.first, each)
    hit = less[_spread(begin[entry], each)] | np.repeat(e.doc > e.low[entry], each)
    change = np.zeros(len(c.words) + 1, np.int32)
    np.add.at(change, start[hit], 1)
    np.add.at(change, start[hit] + c.length, -1)
    return np.cumsum(change[:-1]) > 0


def _free_name(columns: list[str], base: str) -> str:
    taken = {c.lower() for c in columns}
    while base in taken:
        base += "_"
    return base


def _deduplicated(src: DataFrame, id_col: str, text_col: str, length: int, prefix: int, group_runs: int,
                  finish: Callable[[Chunk, list[list[bytes]], list[list[bytes]]], pa.Table], target: T.StructType | str) -> DataFrame:
    if not 0 < prefix <= length or length - prefix >= 1 << 16:
        raise ValueError("suffix trees: a prefix is 1 to length words")
    text_at = src.columns.index(text_col)
    volume = src.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    groups = max(MIN_GROUPS, -(-volume // GROUP_BYTES))
    held = src.withColumn(_free_name(src.columns, "owner"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    texts = chunk_table(held, "tree_chunks")

    def with_chunk(send: Callable) -> Callable:
        return lambda blob, chunk, replies: send(Chunk(blob, text_at, length, prefix), chunk, replies, groups)

    def first(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _send_prefixes(Chunk(blob, text_at, length, prefix), chunk, groups).to_batches()

    def last(c: Chunk, _: int, replies: pa.Table, groups: int) -> pa.Table:
        kind = replies.column("kind").to_numpy()
        gone = _removed(c, replies.filter(pa.array(kind == 1)), replies.filter(pa.array(kind == 2)), groups)
        raw = c.data.tobytes()
        every = [raw[a:b].split() for a, b in zip(c.off[:-1].tolist(), c.off[1:].tolist())]
        at = np.cumsum([0, *map(len, every)]).tolist()
        keep = (~gone).tolist()
        return finish(c, every, [list(compress(w, keep[s:e])) for w, s, e in zip(every, at[:-1], at[1:])])

    prefixes = merged(texts.mapInArrow(first, PACKED), lambda rows: _merge_prefixes(rows, group_runs), "tree-prefixes")
    verdicts = merged(answered(texts, prefixes, with_chunk(_send_suffixes), PACKED),
                      lambda rows: _merge_suffixes(rows, length), "tree-nodes")
    both = prefixes.withColumn("kind", F.lit(1)).unionByName(verdicts.withColumn("kind", F.lit(2)))
    return answered(texts, both, with_chunk(last), target)


def dedup_digests(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, group_runs: int = GROUP_RUNS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row of ``docs``.

    Words are maximal runs of characters other than ASCII white space, unchanged (null text:
    none). Windows are judged on the input; overlaps count; rows with equal ids are not
    smaller than each other. A null id is larger than every other id, and null ids are
    equal. Repeated rows come back repeated, other columns are ignored, an empty table gives
    an empty result. ``prefix`` and ``group_runs`` change how work is grouped, not the result.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def finish(c: Chunk, every: list[list[bytes]], kept: list[list[bytes]]) -> pa.Table:
        sha = [hashlib.sha256(b" ".join(k)).hexdigest() for k in kept]
        n = np.array([len(w) for w in every], np.int64)
        return pa.table({"doc_id": c.batch.column(0), "n_words": n, "n_removed": n - np.array([len(k) for k in kept], np.int64),
                         "kept_sha256": pa.array(sha, pa.string())})

    return _deduplicated(src, "doc_id", "text", length, prefix, group_runs, finish,
                         "doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_words(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, group_runs: int = GROUP_RUNS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the removed words cut from the texts; see ``dedup_digests``.

    A text that loses words becomes its kept words joined by one space; others, null ones
    too, stay as they are. Other columns may have any name."""
    src = docs.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])

    def finish(c: Chunk, every: list[list[bytes]], kept: list[list[bytes]]) -> pa.Table:
        at = src_columns.index(text_col)
        texts = [t if len(w) == len(k) else b" ".join(k).decode() for t, w, k in zip(c.batch.column(at).to_pylist(), every, kept)]
        cols = list(c.batch.columns)[:-1]
        cols[at] = pa.array(texts, pa.string())
        return pa.table(dict(zip(src_columns, cols)))

    src_columns = list(src.columns)
    return _deduplicated(src, id_col, text_col, length, prefix, group_runs, finish, src.schema)
