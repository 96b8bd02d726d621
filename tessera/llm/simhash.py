"""SimHash near-duplicate groups by bit-sliced comparison.

Fingerprints are made in Arrow batches, one per document. Equal fingerprints are
one node. Two fingerprints within ``radius`` bits agree in all but ``radius`` of
``blocks`` equal slices of the word, so every choice of ``blocks - radius`` slices
is a bucket table. Buckets are cut into tiles of bounded size, and each pair of
tiles is compared bit-sliced: one side as 64 vertical bit planes, many distances
advanced at once by carry-save counters, rows given up as soon as all of their
distances exceed the radius. A tile pair returns a spanning forest of its links,
never the pairs themselves; components are found over those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_rows, cut, forest, free, shuffle_partitions
from .components import components

TILE = 512
SLAB = 1 << 15  # shingle hashes whose bits are counted at once


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of one UTF-8 text as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for s in range(0, len(h), SLAB):
        bits = np.unpackbits(h[s:s + SLAB].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp long)`` of every row; null and word-less texts have fingerprint 0."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in byte_rows(b, "text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, fp long")


class BitSlices:
    """Vertical bit planes of up to a few hundred 64-bit words, and the distance test."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pad = np.zeros((64, -(-self.n // 64) * 64), np.uint8)
        pad[:, :self.n] = bits.T
        self.planes = np.packbits(pad, axis=1, bitorder="little").view("<u8")
        self.dead = ~np.packbits(np.arange(pad.shape[1]) < self.n, bitorder="little").view("<u8")

    def within(self, probes: np.ndarray, radius: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (probe, word) whose distance is at most ``radius``.

        The counters start at ``2**levels - 1 - radius``: a carry out of the top
        level means that the distance exceeds the radius. Every ``step`` planes,
        probes with no distance left inside the radius are given up.
        """
        levels = max(1, radius.bit_length())
        start = (1 << levels) - 1 - radius
        rows = np.arange(len(probes))
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        shape = (len(probes), self.planes.shape[1])
        count = [np.full(shape, full if start >> k & 1 else 0, np.uint64) for k in range(levels)]
        over = np.broadcast_to(self.dead, shape).copy()
        left = np.asarray(probes, np.uint64)
        for p in range(64):
            flip = np.where(left >> np.uint64(p) & np.uint64(1), full, np.uint64(0))
            carry = self.planes[p][None, :] ^ flip[:, None]
            for k in range(levels):
                carry, count[k] = count[k] & carry, count[k] ^ carry
            over |= carry
            if p % step == step - 1:
                alive = (over != full).any(axis=1)
                if not alive.all():
                    rows, left, over = rows[alive], left[alive], over[alive]
                    count = [c[alive] for c in count]
                    if len(rows) == 0:
                        break
        near = np.unpackbits((~over).astype("<u8").view(np.uint8), axis=1, bitorder="little") if len(rows) else np.zeros((0, 0))
        a, b = np.nonzero(near)
        return rows[a], b


def _tile_links(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one pair of tiles (``right`` None: within one tile)."""
    if right is None:
        a, b = BitSlices(left).within(left, radius)
        words = left
    else:
        a, b = BitSlices(right).within(left, radius)
        b = b + len(left)
        words = np.concatenate([left, right])
    root = forest(a, b, len(words))
    moved = np.nonzero(root != np.arange(len(words)))[0]
    return words[moved], words[root[moved]]


def links(fps: DataFrame, radius: int = 2, blocks: int = 4, tile: int = TILE) -> DataFrame:
    """``(u, v)``: links that span the same components as all pairs within ``radius`` bits.

    ``fps``: distinct ``fp`` longs. Buckets larger than ``tile`` are dealt over
    pairs of tiles by a hash of the fingerprint, so no task holds a whole bucket.
    """
    if not 0 <= radius < blocks or 64 % blocks:
        raise ValueError("radius must be below blocks, and blocks must divide 64")
    spark = fps.sparkSession
    width = 64 // blocks
    part = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(blocks)]
    choices = list(combinations(range(blocks), blocks - radius))
    buckets = F.array(*(F.xxhash64(F.lit(k), *(part[i] for i in pick)) for k, pick in enumerate(choices)))
    rows = fps.select("fp", F.explode(buckets).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    dealt = (rows.join(sizes.hint("merge"), "bucket").withColumn("t", tiles)
             .withColumn("i", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("t")).cast("int"))
             .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
             .select("fp", "bucket", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"),
                     (F.col("i") <= F.col("j")).alias("first")))

    def compare(batches):
        for key, _, fp, first in grouped(batches, ["bucket", "a", "b"]):
            if key[1] == key[2]:
                u, v = _tile_links(fp, None, radius)
            else:
                u, v = _tile_links(fp[first], fp[~first], radius)
            yield u, v

    def run(batches):
        us, vs, held = [], [], 0
        for u, v in compare(batches):
            us.append(u)
            vs.append(v)
            held += len(u)
            if held > 1 << 16:
                yield _pairs(us, vs)
                us, vs, held = [], [], 0
        if us:
            yield _pairs(us, vs)

    placed = dealt.repartition(shuffle_partitions(spark), "bucket", "a", "b").sortWithinPartitions("bucket", "a", "b")
    return placed.mapInArrow(run, "u long, v long")


def _pairs(us: list, vs: list) -> pa.RecordBatch:
    u, v = (np.concatenate(x).view(np.int64) for x in (us, vs))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def grouped(batches, keys: list[str]) -> Iterator[tuple[tuple, int, np.ndarray, np.ndarray]]:
    """Runs of equal keys in sorted Arrow batches: (key, rows, fp, first), across batch ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    current: tuple | None = None

    def out():
        fp = np.concatenate([h[0] for h in held])
        return current, len(fp), fp, np.concatenate([h[1] for h in held])

    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy() for k in keys]
        fp = b.column(b.schema.get_field_index("fp")).to_numpy().view(np.uint64)
        first = b.column(b.schema.get_field_index("first")).to_numpy(zero_copy_only=False)
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = np.append(np.nonzero(change)[0], b.num_rows)
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
            key = tuple(int(c[s]) for c in cols)
            if key != current:
                if held:
                    yield out()
                held, current = [], key
            held.append((fp[s:e], first[s:e]))
    if held:
        yield out()


def _named(docs: DataFrame, shingle: int, radius: int, blocks: int, tile: int, id_col: str,
           text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, fp)`` of every row, and ``(fp, root, component_id)`` of every fingerprint; ``root`` tells components apart."""
    fps = cut(fingerprints(docs, shingle, id_col, text_col), "simhash-fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comp = components(links(nodes.select("fp"), radius, blocks, tile))
    rooted = nodes.join(comp.hint("merge"), nodes.fp == comp.node, "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps, cut(rooted.select("fp", "root").join(low.hint("merge"), "root").select("fp", "root", "component_id"), "simhash-names")


def simhash_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 4, tile: int = TILE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable through links of at most
    ``radius`` differing bits. Null texts count as empty; empty texts have
    fingerprint 0 and link like any other. Repeated rows come back repeated. A
    null id keeps its row and takes part in links; a group of null ids alone has
    a null ``component_id``. Other columns of ``docs`` are ignored. An empty table
    gives an empty result.
    """
    fps, names = _named(docs, shingle, radius, blocks, tile, id_col, text_col)
    return fps.join(names.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one_per_group(docs: DataFrame, shingle: int = 3, radius: int = 2, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row of each group of ``docs``, with the smallest id of the group; columns unchanged.

    A row with a null id stays (no group is named after it). Of a group's rows that
    repeat the kept id, one stays: the one with the smallest text, then other columns.
    Where an id has rows in several groups and is the smallest of each, each keeps its own.
    """
    fps, names = _named(docs, shingle, radius, 4, TILE, id_col, text_col)
    own, whole, mark, keep_id, keep_fp, root = (
        free(n, docs.columns) for n in ("__id", "__text", "__fp", "__keep", "__keep_fp", "__root"))
    keep = fps.join(names.hint("merge"), "fp").where("doc_id = component_id").select(
        F.col("doc_id").alias(keep_id), F.col("fp").alias(keep_fp), F.col("root").alias(root)).distinct()

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in byte_rows(b, whole)), np.uint64, b.num_rows)
            at = b.schema.get_field_index(whole)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(fps.view(np.int64))], [*b.schema.names[:at], mark])

    marked = docs.where(F.col(id_col).isNotNull()).select(
        *[F.col(f"`{c}`") for c in docs.columns], F.col(id_col).cast("long").alias(own), F.col(text_col).cast("string").alias(whole))
    marked = marked.mapInArrow(run, T.StructType([*marked.schema.fields[:-1], T.StructField(mark, T.LongType())]))
    kept = marked.join(keep.hint("merge"), (F.col(own) == F.col(keep_id)) & (F.col(mark) == F.col(keep_fp)))
    first = free("__t", docs.columns)
    once = kept.groupBy(root).agg(
        F.min(F.struct(F.col(text_col).alias(first), *[F.col(f"`{c}`") for c in docs.columns])).alias("__row"))
    return once.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns]).unionByName(
        docs.where(F.col(id_col).isNull()))
