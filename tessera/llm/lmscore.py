"""Language-model scores from a log-frequency Bloom filter.

Counts of words and word pairs of the training texts are quantised on a log scale;
an n-gram of level q is entered q times into a Bloom filter, as (n-gram, 1) to
(n-gram, q). A count is read back by probing (n-gram, 1), (n-gram, 2), ... until the
first miss. The smoothed probability of a word after another interpolates the pair's
read count with the word's own by a fixed prior weight.

Counting: tasks count bounded runs of text and send one packed row per bucket (the
leading bits of the n-gram's hash), so a frequent n-gram costs one entry per run. A
bucket is merged in one group, and its part of the filter is built there, sized by
its own entries. The number of buckets grows with the text, so groups stay bounded.

Scoring: the filter's parts and the exact word table (for the base score) reach the
workers as broadcasts of at most ``SEGMENT_BYTES``. If there is more, it is scored in
several passes over the texts, one segment each; a pass hands the counts that it has
read on to the next in two packed columns, written in between.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_fold, cut, mix64, utf8_column
from .tokens import chunks, words

BASE = 1.5  # ratio between quantisation levels
HASHES = 6
PRIOR = 100.0  # weight of the word's own probability against the pair's count
RUN_TOKENS = 1_500_000  # distinct n-grams held before they are sent on
BUCKET_BYTES = 8 << 20  # text bytes per bucket
MIN_BUCKETS = 256
SEGMENT_BYTES = 128 << 20
END = np.uint64(0x51ED270B9F1E4D03)
START = np.uint64(0xA0761D6478BD642F)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
LEVELS = 64


def quantise(counts: np.ndarray) -> np.ndarray:
    """Level of a count: 1 + floor(log(count) / log(BASE)); 0 for count 0."""
    c = np.asarray(counts, np.float64)
    return np.where(c > 0, 1 + np.floor(np.log(np.maximum(c, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64).clip(0, LEVELS - 1)


def level_values() -> np.ndarray:
    """Mean count of each level."""
    out = np.zeros(LEVELS)
    for q in range(1, LEVELS):
        lo, hi = int(np.ceil(BASE ** (q - 1) - 1e-9)), int(np.ceil(BASE ** q - 1e-9)) - 1
        out[q] = (lo + max(lo, hi)) / 2
    return out


def sequences(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(token, pair, text)`` hashes of all words and ends of the texts, in order."""
    h, _, _, text = words(data, off)
    n = len(off) - 1
    total = len(h) + n
    token, owner = np.empty(total, np.uint64), np.empty(total, np.int64)
    at = np.arange(len(h)) + text
    ends = np.cumsum(np.bincount(text, minlength=n)) + np.arange(n)
    token[at], owner[at] = h, text
    token[ends], owner[ends] = END, np.arange(n)
    before = np.r_[START, token[:-1]]
    before[np.r_[0, ends[:-1] + 1]] = START
    with np.errstate(over="ignore"):
        pair = mix64(before * _PAIR + token)
    return mix64(token), pair, owner


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _packed(kind: int, hashes: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: n-grams seen once, and n-grams with counts (sorted hashes)."""
    edge = np.searchsorted(_bucket(hashes, buckets), np.arange(buckets + 1))
    rows = [(b, hashes[s:e], counts[s:e]) for b, s, e in zip(range(buckets), edge[:-1], edge[1:]) if e > s]
    one = [h[c == 1].tobytes() for _, h, c in rows]
    many = [h[c > 1].tobytes() for _, h, c in rows]
    count = [c[c > 1].astype("<u4").tobytes() for _, _, c in rows]
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()),
         *(pa.array(x, pa.binary()) for x in (one, many, count))], ["kind", "bucket", "one", "many", "count"])


def _merge(h: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    first = np.nonzero(np.r_[True, h[1:] != h[:-1]])[0] if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(c, first) if len(h) else c


def _probe_bits(h: np.ndarray, level: np.ndarray, bits: np.ndarray, k: int) -> np.ndarray:
    """Bit of the k-th hash function of (n-gram, level) in a part of ``bits`` bits."""
    with np.errstate(over="ignore"):
        x = mix64(h + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1) * np.uint64(0xC2B2AE3D27D4EB4F))
        return ((x >> np.uint64(32)) * bits.astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _count_type(c: np.ndarray) -> str:
    return "<u4" if len(c) == 0 or int(c.max()) < 1 << 32 else "<u8"


def _build(h: np.ndarray, c: np.ndarray) -> tuple[bytes, int]:
    """The Bloom part of one bucket: sized for its entries at ``HASHES`` functions."""
    level = quantise(c)
    entries = int(level.sum())
    size = max(64, -(-int(entries * HASHES / np.log(2)) // 64) * 64)
    bits = np.zeros(size, np.uint8)
    for q in range(1, int(level.max(initial=0)) + 1):
        some = h[level >= q]
        for k in range(HASHES):
            bits[_probe_bits(some, np.full(len(some), q), np.full(len(some), size), k)] = 1
    return np.packbits(bits, bitorder="little").tobytes(), size


def model_parts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(kind, bucket, n, total, words, counts, bits, size)`` per bucket of the texts' words (1) and pairs (2)."""
    src = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    volume = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-volume // BUCKET_BYTES))

    def count(batches):
        held: dict[int, list] = {1: [], 2: []}
        size = 0

        def out():
            for kind, parts in held.items():
                if parts:
                    h, c = _merge(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                    yield _packed(kind, h, c, buckets)
                    parts.clear()

        for b in batches:
            for _, _, data, off in chunks(*utf8_column(b, "text")):
                token, pair, _ = sequences(data, off)
                for kind, h in ((1, token), (2, pair)):
                    u, c = np.unique(h, return_counts=True)
                    held[kind].append((u, c))
                    size += len(u)
                if size > RUN_TOKENS:
                    yield from out()
                    size = 0
        yield from out()

    def merge(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        one = np.frombuffer(b"".join(t.column("one").to_pylist()), "<u8")
        many = np.frombuffer(b"".join(t.column("many").to_pylist()), "<u8")
        times = np.frombuffer(b"".join(t.column("count").to_pylist()), "<u4").astype(np.int64)
        h, c = _merge(np.concatenate([one, many]), np.concatenate([np.ones(len(one), np.int64), times]))
        kind = key[0].as_py()
        bits, size = _build(h, c)
        keep = kind == 1
        return pa.table({
            "kind": pa.array([kind], pa.int32()), "bucket": pa.array([key[1].as_py()], pa.int32()),
            "buckets": pa.array([buckets], pa.int32()), "n": [len(h)], "total": [int(c.sum())],
            "words": pa.array([h.tobytes() if keep else b""], pa.binary()),
            "counts": pa.array([c.astype(_count_type(c)).tobytes() if keep else b""], pa.binary()),
            "bits": pa.array([bits], pa.binary()), "size": [size]})

    packed = src.mapInArrow(count, "kind int, bucket int, one binary, many binary, count binary")
    return packed.groupBy("kind", "bucket").applyInArrow(
        merge, "kind int, bucket int, buckets int, n long, total long, words binary, counts binary, bits binary, size long")


class Segment:
    """A run of buckets: their parts of the filter and of the exact word table."""

    def __init__(self, rows: Iterable, buckets: int, bit_bytes: int, n_words: int):
        """``rows``: of ``model_parts``, words before pairs, by bucket; taken one at a time
        into arrays of the known size, so no second copy of the segment is held."""
        self.buckets = buckets
        self.known = np.zeros((3, buckets), bool)
        self.size, self.base = np.zeros((3, buckets), np.int64), np.zeros((3, buckets), np.int64)
        self.bits, self.words = np.empty(bit_bytes, np.uint8), np.empty(n_words, np.uint64)
        self.counts = np.empty(n_words, np.uint32)
        at = word = 0
        for r in rows:
            kind, bucket, part = r["kind"], r["bucket"], np.frombuffer(r["bits"], np.uint8)
            self.known[kind, bucket], self.size[kind, bucket], self.base[kind, bucket] = True, r["size"], at * 8
            self.bits[at:at + len(part)] = part
            at += len(part)
            if kind == 1 and r["words"]:
                w = np.frombuffer(r["words"], "<u8")
                c = np.frombuffer(r["counts"], f"<u{len(r['counts']) // len(w)}")
                if c.dtype.itemsize > self.counts.dtype.itemsize:
                    self.counts = self.counts.astype(np.uint64)
                self.words[word:word + len(w)], self.counts[word:word + len(w)] = w, c
                word += len(w)

    def levels(self, kind: int, h: np.ndarray) -> np.ndarray:
        """Level of every n-gram by probing 1, 2, ... until the first miss; 0 outside the segment."""
        bucket = _bucket(h, self.buckets)
        out = np.zeros(len(h), np.int64)
        left = np.nonzero(self.known[kind, bucket])[0]
        for q in range(1, LEVELS):
            for k in range(HASHES):
                x, b = h[left], bucket[left]
                bit = _probe_bits(x, np.full(len(x), q), self.size[kind, b], k) + self.base[kind, b]
                left = left[(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
            if len(left) == 0:
                break
            out[left] = q
        return out

    def exact(self, h: np.ndarray) -> np.ndarray:
        """Training count of every word; 0 if unseen or outside the segment."""
        if len(self.words) == 0:
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], 0).astype(np.int64)


SCORES = "n_tokens long, n_known long, base_score double, score double"
CARRIED = "__token_levels binary, __pair_levels binary, __known long, __base double"


def _pass(df: DataFrame, held, total: int, distinct: int, first: bool, last: bool, text_col: str) -> DataFrame:
    """Reads one segment's counts for all texts; the last pass turns them into scores."""
    target = df.schema if not first else T.StructType([*df.schema.fields, *T.StructType.fromDDL(CARRIED).fields])
    if last:
        plain = [f for f in target.fields if not f.name.startswith("__")]
        target = T.StructType([*plain, *T.StructType.fromDDL(SCORES).fields])
    scale = total + 0.5 * (distinct + 1)

    def run(batches):
        seg: Segment = held.value
        value = level_values()
        for b in batches:
            old = None if first else [b.column(b.schema.get_field_index(c)).to_pylist()
                                      for c in ("__token_levels", "__pair_levels", "__known", "__base")]
            cols: list[list] = [[], [], [], []]
            for s, e, data, off in chunks(*utf8_column(b, text_col)):
                token, pair, owner = sequences(data, off)
                n = e - s
                starts = np.searchsorted(owner, np.arange(n + 1))
                u, inv = np.unique(token, return_inverse=True)
                c = seg.exact(u)[inv]
                lt = seg.levels(1, u)[inv]
                u, inv = np.unique(pair, return_inverse=True)
                lp = seg.levels(2, u)[inv]
                known = np.bincount(owner, c > 0, minlength=n).astype(np.int64)
                base = np.bincount(owner, np.where(c > 0, np.log10((c + 0.5) / scale), 0.0), minlength=n)
                if old is not None:
                    lt = lt + np.frombuffer(b"".join(old[0][s:e]), np.uint8)
                    lp = lp + np.frombuffer(b"".join(old[1][s:e]), np.uint8)
                    known, base = known + np.array(old[2][s:e]), base + np.array(old[3][s:e])
                if not last:
                    for col, lv in zip(cols, (lt, lp)):
                        whole = lv.astype(np.uint8).tobytes()
                        col += [whole[x:y] for x, y in zip(starts[:-1], starts[1:])]
                    cols[2] += known.tolist()
                    cols[3] += base.tolist()
                    continue
                size = np.diff(starts)
                own = (value[lt] + 0.5) / scale
                # count of the word before: that word's level; a start is as frequent as an end
                before = np.r_[0.0, value[lt[:-1]]]
                before[starts[:-1]] = value[lt[starts[1:] - 1]]
                both = np.minimum(value[lp], before)
                p = (both + PRIOR * own) / (before + PRIOR)
                cols[0] += size.tolist()
                cols[1] += known.tolist()
                cols[2] += (base + (size - known) * np.log10(0.5 / scale)).tolist()
                cols[3] += np.bincount(owner, np.log10(p), minlength=n).tolist()
            keep = [c for c, f in zip(b.columns, b.schema) if not f.name.startswith("__")]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64()] if last else [pa.binary(), pa.binary(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(c, t) for c, t in zip(cols, kinds))], target.names)

    return df.mapInArrow(run, target)


def _segments(parts: DataFrame, limit: int) -> list[list[int]]:
    """Buckets dealt into runs whose bytes stay within ``limit`` (one bucket at least)."""
    sizes = parts.groupBy("bucket").agg(
        F.sum(F.length("words") + F.length("counts") + F.length("bits")).alias("n")).orderBy("bucket").collect()
    out: list[list[int]] = []
    held = 0
    for r in sizes:  # one row per 8 MB of text
        if not out or held + r.n > limit:
            out.append([])
            held = 0
        out[-1].append(r.bucket)
        held += r.n
    return out


def _segment(parts: DataFrame, run: list[int]) -> Segment:
    if not run:
        return Segment([], 1, 0, 0)
    mine = parts.where(F.col("bucket").between(run[0], run[-1]))
    facts = mine.agg(F.max("buckets").alias("b"), F.sum(F.length("bits")).alias("bits"),
                     F.sum(F.length("words") / 8).cast("long").alias("words")).first()
    rows = mine.orderBy("kind", "bucket").select("kind", "bucket", "bits", "size", "words", "counts")
    return Segment(rows.toLocalIterator(), facts.b, facts.bits, facts.words)


def score(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """``(doc_id, text, n_tokens, n_known, base_score, score, train_tokens)`` of every row of ``docs``.

    Tokens are the words (A-Z lower-cased, split at ASCII white space), then one end.
    ``score``: log10 probability under the smoothed pair model; ``base_score``: under
    exact add-half word counts. Null texts count as empty: one end. Repeated rows are
    scored alike and repeated training rows count each. An empty training table gives
    every token the same share. Other columns are ignored.
    """
    spark = docs.sparkSession
    parts = cut(model_parts(training, text_col), "lm-parts")
    facts = parts.where("kind = 1").agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
    total, distinct = facts.t or 0, facts.n or 0
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    runs = _segments(parts, segment_bytes) or [[]]
    for i, run in enumerate(runs):
        held = spark.sparkContext.broadcast(_segment(parts, run))  # at most segment_bytes
        out = _pass(out, held, total, distinct, i == 0, i == len(runs) - 1, "text")
        if i < len(runs) - 1:
            out = cut(out, "lm-pass")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def score_documents(docs: DataFrame, folds: int = 5, held_fold: int = 1, learn: Column | None = None) -> DataFrame:
    """Scores of all ``docs``, learnt from rows whose ``crc32(doc_id) mod folds`` is not ``held_fold``.

    A null id is in no fold: its row is scored, not learnt from and not held out.
    """
    own = crc_fold("doc_id", folds) != held_fold
    scored = score(docs, docs.where(own if learn is None else own & learn))
    return scored.select("doc_id", F.coalesce(crc_fold("doc_id", folds) == held_fold, F.lit(False)).alias("held_out"),
                         "n_tokens", "n_known", "train_tokens", "base_score", "score")
