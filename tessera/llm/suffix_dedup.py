"""Removal of repeated byte strings with suffix structures built column by column.

A byte goes if a string of ``length`` bytes that covers it also starts in a document
with a smaller id. Documents lie in chunks of bounded size, written once as a table
bucketed by chunk, so that what is learnt about a chunk meets its texts again without
moving them. Three rounds narrow the windows down, and none loses a match:

1. Anchors. Every window picks the smallest-hashed short run inside it (``windows``),
   so equal windows have equal anchors. Each chunk sends its distinct anchors once;
   those that occur in one document only are done with.
2. Contents. For the other anchors, each chunk sends the hashes of all bytes of the runs
   of windows that share the anchor, and the smallest document of each. A run that a
   smaller document has as a whole goes as a whole; where an anchor has one content
   only, nothing else is to be told.
3. Windows. Of an anchor with several contents, the run of the smallest document of each
   stands for all. These are short texts, and a chunk builds the Burrows-Wheeler transform
   and common prefixes of its collection of them, one symbol per text each round (``bwt``).
   Suffixes that share ``length`` bytes are one window; its smallest document goes to
   all chunks that sent it.

All exchanges carry packed rows per (chunk, bucket of hashes), distinct within the
chunk, so a passage that every document holds is no larger than any other. Runs of
long texts are cut into slices, which only changes how windows are grouped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bwt
from .common import free, mix64, utf8_column
from .exchange import PACKED, answered, bucket_edges, bucket_of, chunk_table, decoded, from_planes, merged, packed_rows, planes
from .tokens import hash_spans
from .windows import anchors

SLICE = 1 << 17  # bytes hashed at once: their arrays stay in a core's cache
BUCKET_BYTES = 16 << 20
MIN_BUCKETS = 256
PIECES = 4096  # short texts per collection
NO_ID = (1 << 63) - 1
_LOW = np.uint64(0xFFFFFFFF)


def _group_min(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key, doc = key[order], doc[order]
    first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
    return key[first], np.minimum.reduceat(doc, first) if len(first) else doc


def slices(data: np.ndarray, off: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """``(data, offsets, first text, first byte)``: whole texts, or overlapping parts of a long one."""
    n, s = len(off) - 1, 0
    while s < n:
        e = int(np.searchsorted(off, off[s] + SLICE, side="right")) - 1
        if e > s:
            yield data[off[s]:off[e]], off[s:e + 1] - off[s], s, int(off[s])
            s = e
            continue
        a, end = int(off[s]), int(off[s + 1])
        while True:
            z = min(a + SLICE + length - 1, end)
            yield data[a:z], np.array([0, z - a]), s, a
            if z == end:
                break
            a += SLICE
        s += 1


class Chunk:
    """The rows of a chunk and the anchor runs of its texts."""

    def __init__(self, blob: bytes, text_col: str, length: int, id_col: str = "__id"):
        self.batch = decoded(blob)
        self.data, self.off = utf8_column(self.batch, text_col)
        self.length = length
        self.ids = self.batch.column(self.batch.schema.get_field_index(id_col)).to_numpy()
        parts = []
        for data, off, text, base in slices(self.data, self.off, length):
            a = anchors(data, off, length)
            parts.append((a.text + text, a.first + base, a.last + base, a.hash, a.content))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2
        text, self.first, self.last, self.hash, self.content = cols
        self.doc = self.ids[text]

    def cut_key(self, buckets: int) -> np.ndarray:
        """Bucket and 32 bits of each run's anchor; anchors that fall together are told apart later."""
        return bucket_of(self.hash, buckets) << np.uint64(32) | self.hash & _LOW


def _keys(row_bucket: int, key: np.ndarray) -> np.ndarray:
    return np.uint64(row_bucket) << np.uint64(32) | key.astype(np.uint64)


def _send_anchors(c: Chunk, chunk: int, buckets: int) -> pa.Table:
    key = c.cut_key(buckets)
    order = np.argsort(key, kind="stable")
    k, d = key[order], c.doc[order]
    first = np.nonzero(np.r_[True, k[1:] != k[:-1]])[0] if len(k) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first) if len(first) else np.zeros(0, bool)
    k = k[first]
    b = (k >> np.uint64(32)).astype(np.int64)
    edge = np.r_[np.nonzero(np.r_[True, b[1:] != b[:-1]])[0], len(k)] if len(k) else np.zeros(1, np.int64)
    return packed_rows(chunk, [(int(b[s]), (k[s:e] & _LOW).astype("<u4").tobytes(), np.packbits(several[s:e]).tobytes(), b"")
                         for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())])


def _merge_anchors(rows: pa.Table) -> pa.Table:
    """For each chunk's anchors of a bucket: is there another document that has it?"""
    keys = [np.frombuffer(k, "<u4") for k in rows.column("keys").to_pylist()]
    several = [np.unpackbits(np.frombuffer(a, np.uint8))[:len(k)] for a, k in zip(rows.column("a").to_pylist(), keys)]
    _, at, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    more = ((count > 1) | (np.bincount(at, np.concatenate(several)) > 0))[at]
    out, s = [], 0
    bucket = rows.column("bucket")[0].as_py()
    for chunk, k in zip(rows.column("chunk").to_pylist(), keys):
        mine = more[s:s + len(k)]
        s += len(k)
        if mine.any():
            out.append(packed_rows(chunk, [(bucket, k[mine].tobytes(), b"", b"")]))
    return pa.concat_tables(out) if out else packed_rows(0, [])


def _new(key: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Where another pair begins among sorted pairs."""
    return np.nonzero(np.r_[True, (key[1:] != key[:-1]) | (content[1:] != content[:-1])])[0] if len(key) else np.zeros(0, np.int64)


def _among(known: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted known ones."""
    if len(known) == 0:
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key


def _lookup(c: Chunk, replies: pa.Table, buckets: int) -> np.ndarray:
    """The runs whose anchor is in the replies."""
    known = np.concatenate([np.zeros(0, np.uint64), *(
        _keys(b, np.frombuffer(k, "<u4")) for b, k in zip(replies.column("bucket").to_pylist(), replies.column("keys").to_pylist()))])
    return np.nonzero(_among(np.sort(known), c.cut_key(buckets)))[0]


def _send_contents(c: Chunk, chunk: int, replies: pa.Table, buckets: int) -> pa.Table:
    """The different contents below each repeated anchor, each with its smallest document."""
    run = _lookup(c, replies, buckets)
    key, content, doc = c.cut_key(buckets)[run], c.content[run], c.doc[run]
    order = np.lexsort((content, key))
    key, content, doc = key[order], content[order], doc[order]
    first = _new(key, content)
    if len(first) == 0:
        return packed_rows(chunk, [])
    low, key, content = np.minimum.reduceat(doc, first), key[first], content[first]
    b = (key >> np.uint64(32)).astype(np.int64)
    edge = np.r_[np.nonzero(np.r_[True, b[1:] != b[:-1]])[0], len(key)]
    return packed_rows(chunk, [(int(b[s]), (key[s:e] & _LOW).astype("<u4").tobytes(), content[s:e].astype("<u8").tobytes(),
                          planes(low[s:e].astype("<i8"))) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())])


def _merge_contents(rows: pa.Table) -> pa.Table:
    """For each content sent: has a smaller document the same one, and has its anchor other ones?"""
    lists = [rows.column(n).to_pylist() for n in ("keys", "a", "b")]
    key = np.concatenate([np.frombuffer(x, "<u4") for x in lists[0]])
    content = np.concatenate([np.frombuffer(x, "<u8") for x in lists[1]])
    doc = np.concatenate([from_planes(x, "<i8") for x in lists[2]])
    order = np.lexsort((content, key))
    k, first = key[order], _new(key[order], content[order])
    size = np.diff(np.r_[first, len(k)])
    low = np.repeat(np.minimum.reduceat(doc[order], first), size)
    _, anchor, contents = np.unique(k[first], return_inverse=True, return_counts=True)
    less, differ = np.empty(len(k), bool), np.empty(len(k), bool)
    less[order] = low < doc[order]
    differ[order] = np.repeat(contents[anchor] > 1, size)
    out, s = [], 0
    bucket = rows.column("bucket")[0].as_py()
    for chunk, x in zip(rows.column("chunk").to_pylist(), lists[0]):
        e = s + len(x) // 4
        out.append(packed_rows(chunk, [(bucket, x, np.packbits(less[s:e]).tobytes(), np.packbits(differ[s:e]).tobytes())]))
        s = e
    return pa.concat_tables(out)


def _verdicts(c: Chunk, replies: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(run, gone, open)`` of the runs whose anchor repeats, contents in the order sent: a smaller
    document has the whole run, or only windows can tell."""
    rows = sorted(zip(*(replies.column(n).to_pylist() for n in ("bucket", "keys", "a", "b"))), key=lambda r: r[0])
    known = np.concatenate([np.zeros(0, np.uint64), *(_keys(b, np.frombuffer(k, "<u4")) for b, k, _, _ in rows)])
    less, differ = (np.concatenate([np.zeros(0, bool), *(
        np.unpackbits(np.frombuffer(r[n], np.uint8))[:len(r[1]) // 4].astype(bool) for r in rows)]) for n in (2, 3))
    key = c.cut_key(buckets)
    run = np.nonzero(_among(known, key))[0]
    run = run[np.lexsort((c.content[run], key[run]))]
    first, doc = _new(key[run], c.content[run]), c.doc[run]
    if len(first) != len(known):
        raise RuntimeError("contents sent and answered differ")
    size = np.diff(np.r_[first, len(run)])
    low = np.repeat(np.minimum.reduceat(doc, first), size) if len(run) else doc
    gone = np.repeat(less, size) | (low < doc)
    return run, gone, np.repeat(differ, size) & ~gone


def windows_of_pieces(data: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray,
                      length: int) -> tuple[np.ndarray, np.ndarray]:
    """``(window hash, smallest document)`` of the distinct windows of a collection of short texts."""
    at = np.cumsum(size) - size
    place = np.repeat(first - at, size) + np.arange(size.sum())
    text = data[place]
    made = bwt.build(text, at, size)
    group = np.cumsum(made.common < length)
    whole = np.nonzero(made.size >= length)[0]
    if len(whole) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, owner = group[whole], made.text[whole]
    new = np.nonzero(np.r_[True, g[1:] != g[:-1]])[0]
    start = at[owner[new]] + size[owner[new]] - made.size[whole[new]]
    return mix64(hash_spans(text, start, start + length)), np.minimum.reduceat(doc[owner], new)


def _send_windows(c: Chunk, chunk: int, replies: pa.Table, buckets: int) -> pa.Table:
    run, _, open_ = _verdicts(c, replies, buckets)
    run = run[open_]  # contents side by side, each in its smallest document only
    content = c.content[run]
    run = run[np.nonzero(np.r_[True, content[1:] != content[:-1]])[0]] if len(run) else run
    # texts of like length end in the same rounds, so a collection takes no more rounds than its texts need
    run = run[np.argsort(c.last[run] - c.first[run], kind="stable")]
    found = []
    for s in range(0, len(run), PIECES):
        some = run[s:s + PIECES]
        size = c.last[some] + c.length - c.first[some]
        # a run of a low-entropy text can be long; cut it so that a piece stays a short text
        reach = 200 - c.length + 1
        parts = np.maximum(1, -(-(size - c.length + 1) // reach))
        owner = np.repeat(some, parts)
        skip = (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)) * reach
        found.append(windows_of_pieces(c.data, c.first[owner] + skip, np.minimum(np.repeat(size, parts) - skip, 200),
                                       c.doc[owner], c.length))
    if not found:
        return packed_rows(chunk, [])
    key, low = _group_min(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))
    return packed_rows(chunk, [(b, planes(key[s:e].astype("<u8")), planes(low[s:e].astype("<i8")), b"")
                         for b, s, e in bucket_edges(key, buckets)])


def _merge_windows(rows: pa.Table) -> pa.Table:
    """To each chunk: its windows of a bucket that start in a smaller document elsewhere."""
    lists = [rows.column(n).to_pylist() for n in ("keys", "a")]
    key = np.concatenate([from_planes(x, "<u8") for x in lists[0]])
    doc = np.concatenate([from_planes(x, "<i8") for x in lists[1]])
    every, low = _group_min(key, doc)
    low = low[np.searchsorted(every, key)]
    out, s = [], 0
    bucket = rows.column("bucket")[0].as_py()
    for chunk, x in zip(rows.column("chunk").to_pylist(), lists[0]):
        e = s + len(x) // 8
        less = low[s:e] < doc[s:e]
        if less.any():
            out.append(packed_rows(chunk, [(bucket, planes(key[s:e][less]), planes(low[s:e][less]), b"")]))
        s = e
    return pa.concat_tables(out) if out else packed_rows(0, [])


def _removed(c: Chunk, contents: pa.Table, windows: pa.Table, buckets: int) -> np.ndarray:
    """Which bytes of the chunk's texts go."""
    run, gone, open_ = _verdicts(c, contents, buckets)
    change = np.zeros(len(c.data) + 1, np.int32)

    def mark(start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)

    mark(c.first[run[gone]], c.last[run[gone]] + c.length)
    open_ = np.sort(run[open_])
    key, start, doc = [], [], []
    edge = np.searchsorted(c.first[open_], np.arange(0, len(c.data) + SLICE, SLICE))
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
        some = open_[s:e]
        if len(some) == 0:
            continue
        n = c.last[some] - c.first[some] + 1
        at = np.repeat(c.first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = int(at.min())
        part = c.data[base:int(at.max()) + c.length]
        key.append(mix64(hash_spans(part, at - base, at - base + c.length)))
        start.append(at)
        doc.append(np.repeat(c.doc[some], n))
    if key:
        key, start, doc = np.concatenate(key), np.concatenate(start), np.concatenate(doc)
        every, least = _group_min(key, doc)
        keys = [from_planes(k, "<u8") for k in windows.column("keys").to_pylist()]
        if keys:
            lows = np.concatenate([from_planes(a, "<i8") for a in windows.column("a").to_pylist()])
            least[np.searchsorted(every, np.concatenate(keys))] = lows
        hit = least[np.searchsorted(every, key)] < doc
        mark(start[hit], start[hit] + c.length)
    return np.cumsum(change[:-1]) > 0


def _deduplicated(docs: DataFrame, id_col: str, text_col: str, length: int, finish: Callable, target: T.StructType) -> DataFrame:
    own = free("__id", docs.columns)
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns],
                      F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias(own))
    src = src.withColumn(text_col, F.col(text_col).cast("string"))
    volume = src.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-volume // BUCKET_BYTES))
    texts = chunk_table(src, "suffix_chunks")

    def first(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _send_anchors(Chunk(blob, text_col, length, own), chunk, buckets).to_batches()

    def with_chunk(send: Callable) -> Callable:
        return lambda blob, chunk, replies: send(Chunk(blob, text_col, length, own), chunk, replies, buckets)

    repeated = merged(texts.mapInArrow(first, PACKED), _merge_anchors, "suffix-anchors")
    contents = merged(answered(texts, repeated, with_chunk(_send_contents), PACKED), _merge_contents, "suffix-contents")
    found = merged(answered(texts, contents, with_chunk(_send_windows), PACKED), _merge_windows, "suffix-windows")
    both = contents.withColumn("kind", F.lit(1)).unionByName(found.withColumn("kind", F.lit(2)))

    def last(c: Chunk, _: int, replies: pa.Table, buckets: int) -> pa.Table:
        kind = replies.column("kind").to_numpy()
        gone = _removed(c, replies.filter(pa.array(kind == 1)), replies.filter(pa.array(kind == 2)), buckets)
        return finish(c, gone)

    return answered(texts, both, with_chunk(last), target)


def dedup_digests(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``docs``.

    Texts are UTF-8 bytes (null: empty). Strings are judged on the input; overlaps
    count; rows with equal ids are not smaller than each other. A null id is larger
    than every other id, and null ids are equal. Repeated rows come back repeated,
    other columns are ignored, an empty table gives an empty result.
    """
    target = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(c: Chunk, gone: np.ndarray) -> pa.Table:
        starts = gone & ~np.r_[False, gone[:-1]]
        starts[c.off[:-1][c.off[:-1] < len(gone)]] |= gone[c.off[:-1][c.off[:-1] < len(gone)]]
        sums = [np.r_[0, np.cumsum(x)] for x in (gone, starts)]
        removed, spans = (s[c.off[1:]] - s[c.off[:-1]] for s in sums)
        sha = [hashlib.sha256(c.data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(c.off[:-1], c.off[1:])]
        return pa.table({"doc_id": c.batch.column(c.batch.schema.get_field_index("doc_id")),
                         "n_bytes": np.diff(c.off), "n_removed": removed.astype(np.int64), "n_spans": spans.astype(np.int64),
                         "kept_sha256": pa.array(sha, pa.string())})

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _deduplicated(src, "doc_id", "text", length, finish, target)


def dedup_texts(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, the removed bytes cut from the texts; see ``dedup_digests``.

    Null texts stay null. Bytes of a character that was cut in two are dropped.
    """
    target = docs.select(*[F.col(c).cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]).schema
    own = free("__id", docs.columns)

    def finish(c: Chunk, gone: np.ndarray) -> pa.Table:
        at = c.batch.schema.get_field_index(text_col)
        null = c.batch.column(at).is_null().to_pylist()
        kept = [None if n else c.data[a:b][~gone[a:b]].tobytes().decode("utf-8", "ignore")
                for n, a, b in zip(null, c.off[:-1].tolist(), c.off[1:].tolist())]
        cols = list(c.batch.columns)
        cols[at] = pa.array(kept, pa.string())
        return pa.table(dict(zip(c.batch.schema.names, cols))).drop_columns([own])

    return _deduplicated(docs, id_col, text_col, length, finish, target)
