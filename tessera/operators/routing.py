"""Message passing on a vertex cut: edge partitions, and a routing table that ships a vertex
once to every partition that needs it.

An edge goes to the cell of a square of partitions that the scrambled numbers of its two
ends choose, so a vertex is needed in at most one row or column of the square. Edges of a
hub (an end with a large share of all edges, told by a sketch) are dealt by both ends over
all partitions instead. An edge partition is one row of arrays, built once: the vertices it
reads (``dst``, the routing table), those it writes (``src``), and its edges as places in
these. A partition of more than ``EDGES`` edges is kept as several rows, its pieces, cut as
the partitions are, so a few partitions of many edges need no more memory. A product ships ``x`` along the routing table, one value per (vertex, piece),
sums inside each piece, and adds the partial sums at their vertices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import _flat, _merged
from .partition import LEAST_SHARE, heavy_keys

PRIME = (1 << 31) - 1
FACTOR = 48271            # multiplier of a Lehmer generator modulo PRIME
EDGES = 1 << 20           # edges per piece, about
EDGE_PARTS = "part int, piece int, n_edges long, dst array<long>, src array<long>, d array<int>, s array<int>, attr array<double>"


def scrambled_text(vertex: str) -> str:
    return f"((pmod({vertex}, {PRIME}) * {FACTOR}) % {PRIME})"


def scrambled(vertex: str) -> Column:
    """A fixed scrambling of a vertex id (arithmetic that any SQL has)."""
    return F.expr(scrambled_text(vertex))


def side(parts: int) -> int:
    """Side of the smallest square of at least ``parts`` partitions."""
    return max(1, int(np.ceil(np.sqrt(parts))))


def hubs(edges: DataFrame, parts: int) -> list[int]:
    """Vertices with more edges (as either end) than a quarter of a row of the square should hold."""
    share = max(0.25 / side(parts), LEAST_SHARE)
    return sorted({k for end in ("src", "dst") for k in heavy_keys(edges, end, share)[0]})


def edge_part(parts: int, hub_ids: list[int]) -> Column:
    q = side(parts)
    square = scrambled("src") % q * q + scrambled("dst") % q
    if not hub_ids:
        return square.cast("int")
    either = (scrambled("src") + scrambled("dst") * 3) % (q * q)
    return F.when(F.col("src").isin(hub_ids) | F.col("dst").isin(hub_ids), either).otherwise(square).cast("int")


def edge_piece(parts: int, pieces: int, hub_ids: list[int]) -> Column:
    """The piece of an edge in its partition, one of a square of at least ``pieces``: by what the choice of
    the partition has left of the scrambled numbers."""
    q, h = side(parts), side(pieces)
    square = F.expr(f"({scrambled_text('src')} div {q}) % {h} * {h} + ({scrambled_text('dst')} div {q}) % {h}")
    if not hub_ids:
        return square.cast("int")
    either = F.expr(f"({scrambled_text('src')} div {q * q} + {scrambled_text('dst')} div {q * q}) % {h * h}")
    return F.when(F.col("src").isin(hub_ids) | F.col("dst").isin(hub_ids), either).otherwise(square).cast("int")


def _built(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    dst, d = np.unique(rows.column("dst").to_numpy(), return_inverse=True)
    src, s = np.unique(rows.column("src").to_numpy(), return_inverse=True)
    order = np.argsort(s, kind="stable")
    return pa.table({
        "part": pa.array([key[0].as_py()], pa.int32()), "piece": pa.array([key[1].as_py()], pa.int32()),
        "n_edges": pa.array([rows.num_rows], pa.int64()),
        "dst": pa.array([dst], pa.list_(pa.int64())), "src": pa.array([src], pa.list_(pa.int64())),
        "d": pa.array([d[order]], pa.list_(pa.int32())), "s": pa.array([s[order]], pa.list_(pa.int32())),
        "attr": pa.array([rows.column("attr").to_numpy()[order]], pa.list_(pa.float64()))})


def edge_partitions(edges: DataFrame, parts: int, hub_ids: list[int] | None = None, piece_edges: int = EDGES) -> DataFrame:
    """Edge partitions (see the module) of ``edges (src, dst, attr)``, a row per piece; parallel edges are summed
    first, which changes no product. ``parts``: about ``edges / EDGES``, or fewer partitions of several pieces."""
    hub_ids = hubs(edges, parts) if hub_ids is None else hub_ids
    pieces = max(1, -(-edges.count() // (parts * piece_edges)))
    one = edges.groupBy("src", "dst").agg(F.sum(F.col("attr").cast("double")).alias("attr"))
    dealt = one.withColumn("part", edge_part(parts, hub_ids)).withColumn("piece", edge_piece(parts, pieces, hub_ids))
    return dealt.groupBy("part", "piece").applyInArrow(_built, EDGE_PARTS)


def routing_table(parts: DataFrame) -> DataFrame:
    """``(part, piece, at, id)``: which vertex values go where, each (vertex, piece) once."""
    return parts.select("part", "piece", F.posexplode("dst").alias("at", "id"))


def partition_sizes(parts: DataFrame) -> DataFrame:
    """``(part, n_edges, n_in, n_out)``: edges, vertices read and vertices written of every partition; a vertex of
    several pieces counts once."""
    def ends(kind: int, ids: str) -> Column:
        return F.transform(ids, lambda v: F.struct(F.lit(kind).alias("end"), v.alias("id"), F.lit(0).cast("long").alias("n")))

    edges = F.array(F.struct(F.lit(2).alias("end"), F.lit(0).cast("long").alias("id"), F.col("n_edges").alias("n")))
    rows = parts.select("part", F.inline(F.concat(ends(0, "dst"), ends(1, "src"), edges)))
    one = rows.groupBy("part", "end", "id").agg(F.sum("n").alias("n"))
    return one.groupBy("part").agg(F.sum("n").alias("n_edges"), F.count(F.when(F.col("end") == 0, 1)).cast("int").alias("n_in"),
                                   F.count(F.when(F.col("end") == 1, 1)).cast("int").alias("n_out"))


def multiply_routed(parts: DataFrame, vec: DataFrame) -> DataFrame:
    """``(i, x)``: at every source vertex the sum of ``attr * x(dst)`` over its edges."""
    values = vec.select(F.col("i").alias("id"), F.col("x").cast("double").alias("x"))
    shipped = (routing_table(parts).join(values, "id").groupBy("part", "piece")
               .agg(F.collect_list(F.struct("at", "x")).alias("e")).select("part", "piece", F.col("e.at").alias("at"), F.col("e.x").alias("xs")))
    met = parts.join(shipped, ["part", "piece"], "left").select(
        "src", "d", "s", "attr", F.size("dst").alias("n"), F.coalesce("at", F.array().cast("array<int>")).alias("at"),
        F.coalesce("xs", F.array().cast("array<double>")).alias("xs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (src, so), (d, do), (s, _), (attr, _), (at, ao), (xs, _) = (_flat(b.column(n)) for n in ("src", "d", "s", "attr", "at", "xs"))
            n = b.column("n").to_numpy()
            for r in range(b.num_rows):
                x = np.zeros(n[r])
                x[at[ao[r]:ao[r + 1]]] = xs[ao[r]:ao[r + 1]]
                e = slice(do[r], do[r + 1])
                ids = src[so[r]:so[r + 1]]
                sums = np.bincount(s[e], weights=attr[e] * x[d[e]], minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sums)], ["i", "x"])

    return met.mapInArrow(_merged(run), "i long, x double").groupBy("i").agg(F.sum("x").alias("x"))
