"""Audit of filters that overlap: what each removes in every order, with an exact duplicate filter.

Duplicates are told in two steps. Every chunk of documents adds its texts to a sparse
part of a counting Bloom filter (the slots that its texts use, with counts); the parts of
a bucket of slots are merged by one group, which answers each chunk with the merged
counters at the chunk's own slots. A text with a slot that counts one is unique for
certain. Only the others, once per chunk, move in full, and one grouped minimum gives
the smallest id of each whole text.

The sketch grows with the rows (``SLOTS`` a document) and lies in as many buckets as it
needs: nothing of it is broadcast or reaches the driver. A text that a third of all
documents hold is one count per chunk in the sketch and one row per chunk in the minimum.

Flags then become a mask per document, masks become counts per part, and the counts of
at most 32 masks give every order of the filters: the counts add up, so no document is
read again.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_rows, cut, mix64, shuffle_partitions
from .exchange import PACKED, answered, bucket_edges, bucket_of, chunk_table, decoded, merged, packed_rows

LETTERS = "ABCDE"
DUPLICATE = 1 << LETTERS.index("E")
SLOTS = 16          # counters per document
PROBES = 3          # counters that a text adds to
BUCKET_SLOTS = 1 << 20
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))
FACTS = "doc_id long, part string, mask int, h1 long, h2 long, possible boolean, text string"


def text_mask(raw: bytes) -> int:
    """The filters A to D that a text (UTF-8) fails, as bits; words are split at ASCII white space."""
    words = raw.split()
    n = len(words)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    points = len(raw.translate(None, _CONTINUED))
    return ((n < MIN_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * n) << 1
            | (100 * upper > UPPER_PERCENT * points) << 2 | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


class _Slots:
    """The counters that a chunk's texts use: bucket and slot packed in one sorted key."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, buckets: int):
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        bucket = bucket_of(mix64(h1), buckets) << np.uint64(32)
        with np.errstate(over="ignore"):
            probe = [mix64(h2 + np.uint64(i) * h1) % np.uint64(BUCKET_SLOTS) for i in range(PROBES)]
        key = np.concatenate([bucket | p for p in probe]) if len(h1) else np.zeros(0, np.uint64)
        self.key, at, count = np.unique(key, return_inverse=True, return_counts=True)
        self.count = np.minimum(count, 2).astype(np.uint8)
        self.at = at.reshape(PROBES, -1)

    def parts(self) -> Iterator[tuple[int, int, int]]:
        """``(bucket, first, last)`` of the keys."""
        b = (self.key >> np.uint64(32)).astype(np.int64)
        edge = np.r_[np.nonzero(np.r_[True, b[1:] != b[:-1]])[0], len(b)] if len(b) else np.zeros(1, np.int64)
        yield from ((int(b[s]), s, e) for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()))


def _hashes(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    with pa.ipc.open_stream(blob, options=pa.ipc.IpcReadOptions(included_fields=[3, 4])) as rows:
        t = rows.read_all()
    return t.column(0).to_numpy(), t.column(1).to_numpy()


def _send_sketch(blob: bytes, chunk: int, buckets: int) -> pa.Table:
    s = _Slots(*_hashes(blob), buckets)
    low = (s.key & np.uint64(0xFFFFFFFF)).astype("<u4")
    return packed_rows(chunk, [(b, low[f:e].tobytes(), s.count[f:e].tobytes(), b"") for b, f, e in s.parts()])


def _merge_sketch(rows: pa.Table) -> pa.Table:
    """The merged counters of a bucket; to each chunk, which of its slots count more than one."""
    counter = np.zeros(BUCKET_SLOTS, np.uint8)
    lists = [(np.frombuffer(k, "<u4"), np.frombuffer(a, np.uint8)) for k, a in
             zip(rows.column("keys").to_pylist(), rows.column("a").to_pylist())]
    for slot, count in lists:
        counter[slot] = np.minimum(counter[slot] + count, 2)
    bucket = rows.column("bucket")[0].as_py()
    out = []
    for chunk, (slot, _) in zip(rows.column("chunk").to_pylist(), lists):
        more = counter[slot] > 1
        if more.any():
            out.append(packed_rows(chunk, [(bucket, np.packbits(more).tobytes(), b"", b"")]))
    return pa.concat_tables(out) if out else packed_rows(0, [])


def _facts(blob: bytes, replies: pa.Table, buckets: int) -> pa.Table:
    """The chunk's documents with their masks, and the possible repeats' texts, once each."""
    rows = decoded(blob)
    h1, h2 = (rows.column(i).to_numpy() for i in (3, 4))
    slots = _Slots(h1, h2, buckets)
    more = np.zeros(len(slots.key), bool)
    bits = dict(zip(replies.column("bucket").to_pylist(), replies.column("keys").to_pylist()))
    for b, s, e in slots.parts():
        if b in bits:
            more[s:e] = np.unpackbits(np.frombuffer(bits[b], np.uint8))[:e - s]
    possible = more[slots.at].all(axis=0) if rows.num_rows else np.zeros(0, bool)
    ids = rows.column(0).to_pylist()
    masks, first = [], {}
    for n, raw in enumerate(byte_rows(rows, "text")):
        masks.append(text_mask(raw))
        if possible[n] and ids[n] is not None and (raw not in first or ids[n] < ids[first[raw]]):
            first[raw] = n
    carried: list[str | None] = [None] * rows.num_rows
    for raw, n in first.items():
        carried[n] = raw.decode()
    return pa.table({"doc_id": rows.column(0), "part": rows.column(1), "mask": pa.array(masks, pa.int32()),
                     "h1": rows.column(3), "h2": rows.column(4), "possible": pa.array(possible, pa.bool_()),
                     "text": pa.array(carried, pa.string())})


def _text_hashes(text) -> list:
    """128 bits of a text in two columns."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")]


def flag_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(doc_id, part, mask)`` for every row of ``docs``: the filters it fails, bit 0 for A.

    A: under 100 words; B: distinct words below 80 %; C: letters A-Z above 10 % of code
    points; D: holds a symbol of ``SYMBOLS``; E: the whole text equals that of a smaller id.
    Null texts are empty, null parts the empty string. A null id is neither smaller nor
    larger than any other, so it neither fails E nor makes another fail it; rows with equal
    ids and texts are not smaller than each other. An empty table gives an empty result;
    other columns, whatever their names, are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                      text.alias("text"), *_text_hashes(text))
    buckets = max(shuffle_partitions(docs.sparkSession), -(-docs.count() * SLOTS // BUCKET_SLOTS))
    chunks = chunk_table(src, "audit_chunks")

    def sketch(batches):
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield from _send_sketch(blob, chunk, buckets).to_batches()

    repeats = merged(chunks.mapInArrow(sketch, PACKED), _merge_sketch, "audit-sketch")
    facts = cut(answered(chunks, repeats, lambda blob, _, replies: _facts(blob, replies, buckets), FACTS), "audit-facts")
    first = facts.where("text is not null").groupBy("text").agg(F.min("doc_id").alias("doc_id"))
    first = first.select("doc_id", *_text_hashes(F.col("text")), F.lit(True).alias("is_first"))
    again = F.col("possible") & F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    return facts.drop("text").join(first, ["doc_id", "h1", "h2"], "left").select(
        "doc_id", "part", F.when(again, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))


def mask_counts(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, mask, n, good, toxic)``: documents per part and mask, and those labelled so.

    A document with several label rows counts as labelled if one of them says so."""
    per_doc = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id is not null")
    per_doc = per_doc.groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    each = flags.join(per_doc, "doc_id", "left")
    return each.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"),
        F.count(F.when(F.col("toxic"), 1)).alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """The audit of all orders of the filters from the counts of masks, one row per part, order and step."""
    steps = [("".join(o), k, 1 << LETTERS.index(o[k]), sum(1 << LETTERS.index(x) for x in o[:k]))
             for o in permutations(LETTERS) for k in range(len(LETTERS))]

    def listed(values, kind: str):
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    at = F.col("at")
    each = counts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(len(steps) - 1)))).select(
        "part", "mask", "n", "good", "toxic", F.get(listed([s[0] for s in steps], "string"), at).alias("filter_order"),
        (at % len(LETTERS) + 1).cast("int").alias("step"),
        F.get(listed([s[2] for s in steps], "int"), at).alias("own"),
        F.get(listed([s[3] for s in steps], "int"), at).alias("before"))
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0

    def total(value: str, when):
        return F.sum(F.when(when, F.col(value)).otherwise(F.lit(0))).cast("long")

    table = each.groupBy("part", "filter_order", "step", "own").agg(
        total("n", ~gone & ~fails).alias("kept"), total("n", ~gone & fails).alias("removed"),
        total("n", gone & fails).alias("redundant"), total("n", F.col("mask") == F.col("own")).alias("unique_fails"),
        total("good", ~gone & fails).alias("good_lost"), total("toxic", ~gone & fails).alias("toxic_lost"))
    return table.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole audit of ``docs`` (doc_id, text, lang) against ``labels`` (doc_id, quality, toxic).

    One row per part, order and step, zeros included: ``part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley``. See
    ``flag_documents`` for nulls, ties and repeated rows; no documents, no rows.
    """
    return orders(mask_counts(flag_documents(docs), labels))
