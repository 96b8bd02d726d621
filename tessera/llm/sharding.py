"""Sharding by histogram sort: exact counts below probe keys, refined, then one exchange.

Every row has a sort key and a size. The shards are consecutive key ranges whose
bytes are as equal as the keys allow. The boundaries are found on a narrow written
table of (key, size): each round counts the exact bytes below all probes in one
grouped sum, and each boundary keeps the gap between two probes that holds its
target, until it is within the tolerance or the gap holds one key. Only the
histogram of a round (a few hundred rows, whatever the input) reaches the driver.
Then the rows move once, into pieces of a shard that number their slots.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

KEY_BITS = 62
PIECE_ROWS = 2048


def document_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of a document: 30 bits of its text's hash, then 32 bits of its id's hash.

    Equal texts lie side by side, and the id's bits let a boundary cut through a
    group of copies that is larger than a shard.
    """
    low = F.lit(0xFFFFFFFF).cast("long")
    text = F.shiftrightunsigned(F.xxhash64(F.col(text_col)), 34)
    return F.shiftleft(text, 32).bitwiseOR(F.xxhash64(F.col(id_col).cast("string")).bitwiseAND(low))


def document_size(text_col: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + F.lit(1).cast("long")


def _below(key: str, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most the key, as a balanced chain of comparisons."""

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < F.lit(bounds[mid]).cast("long"), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(bounds))


def boundaries(keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 32) -> list[int]:
    """``shards - 1`` keys; rows with a key below the k-th belong to the first k shards.

    ``keys``: ``(__key long, __size long)`` with keys in ``[0, 2**62)``. A boundary is
    final when its exact bytes are within ``tolerance`` of a shard's mean from the
    target, or when a single key holds the target: then the nearer side is taken.
    """
    total = keys.agg(F.sum("__size")).first()[0] or 0
    if total == 0 or shards < 2:
        return [0] * max(0, shards - 1)
    targets = [total * k / shards for k in range(1, shards)]
    near = tolerance * total / shards
    gaps: dict[int, tuple[int, int]] = {k: (0, 1 << KEY_BITS) for k in range(shards - 1)}
    done: dict[int, int] = {}
    while gaps:
        asked = sorted({lo + (hi - lo) * i // (probes + 1) for lo, hi in gaps.values() for i in range(probes + 2)})
        rows = keys.groupBy(_below("__key", asked).alias("b")).agg(
            F.sum("__size").alias("n"), F.min("__key").alias("lo"), F.max("__key").alias("hi")).collect()
        cells = {r.b: r for r in rows}
        under, sofar = [], 0
        for i in range(len(asked)):
            sofar += cells[i].n if i in cells else 0
            under.append(sofar)
        for k in list(gaps):
            i = max(j for j in range(len(asked)) if under[j] <= targets[k])
            left, right = targets[k] - under[i], under[i + 1] - targets[k]
            cell = cells[i + 1]
            if min(left, right) <= near or cell.lo == cell.hi:
                done[k] = asked[i] if left <= right else cell.hi + 1
                del gaps[k]
            else:
                gaps[k] = (cell.lo, cell.hi + 1)
    out = [done[k] for k in range(shards - 1)]
    return [max(out[:k + 1]) for k in range(len(out))]


def shard_rows(df: DataFrame, shards: int, key: Column, size: Column, tolerance: float = 0.001,
               piece_rows: int = PIECE_ROWS) -> DataFrame:
    """All rows and columns of ``df`` with ``shard int`` (0-based) and ``slot long``.

    The law is ``bytes``: the sums of ``size`` per shard are near equal; they differ
    by no more than the tolerance and the size of the rows of one key at each
    boundary. Slots are gapless from 0 in each shard. Rows with equal keys lie in one
    shard, in any order among themselves. An empty table gives an empty result.
    Input columns named ``shard`` or ``slot`` are replaced.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    kept = [c for c in df.columns if c not in ("shard", "slot")]
    own = "__row"   # the columns of the caller in one, so that no name clashes
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias(own) if kept else F.lit(0).alias(own),
                      key.alias("__key"), size.alias("__size"))
    keys = cut(keyed.select("__key", "__size"), "shard-keys")
    bounds = boundaries(keys, shards, tolerance)
    pieces = max(1, -(-keys.count() // (shards * piece_rows)))
    shard = _below("__key", bounds).cast("int").alias("__shard")
    piece = F.pmod(F.xxhash64("__key", F.lit(7)), F.lit(pieces)).alias("__piece")
    ahead = Window.partitionBy("__shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = keys.select(shard, piece).groupBy("__shard", "__piece").agg(F.count("*").alias("__n")).select(
        "__shard", "__piece", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    starts = cut(starts, "shard-starts")
    inside = Window.partitionBy("__shard", "__piece").orderBy("__key")
    placed = keyed.select("*", shard, piece).withColumn("__rank", F.row_number().over(inside))
    joined = placed.join(starts, ["__shard", "__piece"])
    return joined.select(*[F.col(own).getField(c).alias(c) for c in kept], F.col("__shard").alias("shard"),
                         (F.col("__start") + F.col("__rank") - 1).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
                    tolerance: float = 0.001) -> DataFrame:
    """``shard_rows`` for documents: null texts and null ids are rows like any other."""
    return shard_rows(docs, shards, document_key(id_col, text_col), document_size(text_col), tolerance)
