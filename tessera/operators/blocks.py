"""Two-dimensional grid of compressed blocks: the matrix as one row per block.

Block ``(bi, bj)`` holds the cells with ``i div height = bi`` and ``j div width = bj``, as
compressed columns that are built once: ``cols`` (columns of the block that hold cells),
``ptr`` (where each of them begins, and the end), ``idx`` (rows) and ``val``, with places
inside the block. Only columns with cells are listed, so a nearly empty block costs
nothing for the others; a block holds at most ``height * width`` cells.

A product joins blocks with the vector's blocks and reduces each block in numpy, straight
from its arrays: nothing is grouped, sorted or hashed per cell again, and cells never move.
A column of blocks with many cells is dealt to several chunks (``c``), so that without a
broadcast no task gets a whole hot column; the vector's block is copied to each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import block_of
from ..plans import hint_broadcast
from .structure import canonicalize

HEIGHT, WIDTH = 1024, 4096
CHUNK_CELLS = 1 << 21   # cells of a column of blocks that go to one chunk
SUMMED = 1024           # blocks summed at a time
GRID = ("bi long, bj long, c long, nnz long, cols array<int>, ptr array<int>, idx array<int>, val array<double>")


def _cut_out(t: pa.Table, height: int, width: int) -> pa.RecordBatch:
    """The blocks of whole blocks' cells, which come in the order of their block, column and row."""
    bi, bj, i, j = (t.column(n).to_numpy() for n in ("bi", "bj", "i", "j"))
    new = np.r_[True, (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])]
    first = np.nonzero(new)[0]                                       # a block's first cell
    nnz = np.diff(np.r_[first, len(i)])
    begin = np.nonzero(new | np.r_[True, j[1:] != j[:-1]])[0]        # a stored column's first cell
    owner = np.cumsum(new)[begin] - 1                                # and its block
    n_cols = np.bincount(owner, minlength=len(first))
    ends = np.cumsum(n_cols + 1)                                     # a block has one pointer more than columns
    ptr = np.empty(len(begin) + len(first), np.int32)
    ptr[np.arange(len(begin)) + owner] = begin - first[owner]
    ptr[ends - 1] = nnz

    def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.r_[0, offsets], pa.int32()), pa.array(values, kind))

    cells, blocks = np.r_[first[1:], len(i)], t.take(pa.array(first))
    return pa.RecordBatch.from_arrays([
        *(blocks.column(n).combine_chunks() for n in ("bi", "bj", "c")), pa.array(nnz, pa.int64()),
        lists(np.cumsum(n_cols), (j - bj * width)[begin], pa.int32()), lists(ends, ptr, pa.int32()),
        lists(cells, i - bi * height, pa.int32()), lists(cells, t.column("v").to_numpy(), pa.float64())],
        ["bi", "bj", "c", "nnz", "cols", "ptr", "idx", "val"])


def _compressed(height: int, width: int):
    """Blocks from sorted cells, all of a batch at once: a grid of many small blocks costs by its cells, not
    by its blocks. The last block of a batch waits, as the next batch may go on with it."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            bi, bj = b.column("bi").to_numpy(), b.column("bj").to_numpy()
            last = int(np.argmax((bi == bi[-1]) & (bj == bj[-1])))   # where its last block begins
            goes_on = held and (held[0].column("bi")[0].as_py(), held[0].column("bj")[0].as_py()) == (bi[-1], bj[-1])
            if not goes_on and (held or last):
                yield _cut_out(pa.Table.from_batches([*held, b.slice(0, last)]), height, width)
                held = []
            held.append(b.slice(last))
        if held:
            yield _cut_out(pa.Table.from_batches(held), height, width)

    return build


def chunk_counts(entries: DataFrame, width: int = WIDTH, chunk_cells: int = CHUNK_CELLS) -> DataFrame:
    """``(bj, k)``: chunks per column of blocks, from the stored entries (one map-side combined count)."""
    n = entries.groupBy(block_of("j", width).alias("bj")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("bj", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(chunk_cells))).cast("long").alias("k"))


def grid_blocks(entries: DataFrame, chunks: DataFrame, height: int = HEIGHT, width: int = WIDTH, *,
                few_columns: bool = False) -> DataFrame:
    """Blocks (see the module) of general entries; duplicates are summed first, map-side combined.

    ``chunks``: of ``chunk_counts``; ``few_columns``: the caller has proven that it may be broadcast."""
    cells = canonicalize(entries).select("i", "j", F.col("v").cast("double").alias("v"))
    cells = cells.withColumn("bi", block_of("i", height)).withColumn("bj", block_of("j", width))
    dealt = cells.join(F.broadcast(chunks) if few_columns else chunks, "bj").withColumn("c", F.pmod(F.xxhash64("bi"), F.col("k")))
    # one exchange of cells by block, and one order for all of a task's blocks
    placed = dealt.select("bi", "bj", "c", "i", "j", "v").repartition("bi", "bj", "c").sortWithinPartitions("bi", "bj", "j", "i")
    return placed.mapInArrow(_compressed(height, width), GRID)


def vector_blocks(vec: DataFrame, width: int = WIDTH) -> DataFrame:
    """A vector (unique indices) by block: ``(bj, xb array<double>)``, ``width`` values a block, 0 where none is stored."""
    def dense(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        xb = np.zeros(width)
        xb[rows.column("i").to_numpy() - key[0].as_py() * width] = rows.column("x").to_numpy()
        return pa.table({"bj": pa.array([key[0].as_py()], pa.int64()), "xb": pa.array([xb], pa.list_(pa.float64()))})

    placed = vec.where("i is not null").select(block_of("i", width).alias("bj"), F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))
    return placed.groupBy("bj").applyInArrow(dense, "bj long, xb array<double>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, and where each row's begin and end."""
    offsets = column.offsets.to_numpy()
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def _kernel(height: int):
    """Sums of ``SUMMED`` blocks at a time: those of one row of blocks are summed together, so blocks that are
    kept in row order give about one row per matrix row; any other order is only less compact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bi = b.column("bi").to_numpy()
            (x, xo), (ptr, _), (idx, io), (val, _) = (_flat(b.column(n)) for n in ("x", "ptr", "idx", "val"))
            for s in range(0, b.num_rows, SUMMED):
                e = min(s + SUMMED, b.num_rows)
                owner = np.repeat(np.arange(s, e), np.diff(xo[s:e + 1]))
                at = np.arange(xo[s], xo[e]) + owner      # a block has one pointer more than columns
                here = slice(io[s], io[e])
                rows, place = np.unique(bi[s:e], return_inverse=True)
                cell = np.repeat(place, np.diff(io[s:e + 1])) * height + idx[here]
                y = np.bincount(cell, weights=val[here] * np.repeat(x[xo[s]:xo[e]], ptr[at + 1] - ptr[at]), minlength=len(rows) * height)
                seen = np.zeros(len(y), bool)
                seen[cell] = True
                got = np.nonzero(seen)[0]
                yield pa.RecordBatch.from_arrays([pa.array(rows[got // height] * height + got % height, pa.int64()), pa.array(y[got])], ["i", "x"])

    return run


def _merged(run):
    """Few, larger batches from a kernel that yields many small ones."""
    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in run(batches):
            held.append(b)
            n += b.num_rows
            if n >= 1 << 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if n:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return put_together


def multiply_grid(blocks: DataFrame, chunks: DataFrame, vec: DataFrame, height: int = HEIGHT, width: int = WIDTH, *,
                  broadcast: bool | None = None) -> DataFrame:
    """Blocks times a vector ``(i, x)`` with unique indices: ``(i, x)``, one row per row with cells.

    Blocks meet the vector's block of their column; partial sums meet by row. With a broadcast
    blocks stay where they are; else they meet the vector by (column, chunk)."""
    xb = vector_blocks(vec, width)
    if broadcast:
        met = blocks.join(F.broadcast(xb), "bj", "left")
    else:
        copies = xb.join(chunks, "bj").withColumn("c", F.explode(F.expr("sequence(0L, k - 1)"))).drop("k")
        met = blocks.join(hint_broadcast(copies, broadcast), ["bj", "c"], "left")
    # a block takes along the values of its own columns, however wide the grid is
    x = F.transform("cols", lambda k: F.coalesce(F.get("xb", k), F.lit(0.0)))
    packed = met.select("bi", "ptr", "idx", "val", x.alias("x"))
    part = packed.mapInArrow(_merged(_kernel(height)), "i long, x double")
    return part.groupBy("i").agg(F.sum("x").alias("x"))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (cols, co), (ptr, _), (idx, io), (val, _) = (_flat(b.column(n)) for n in ("cols", "ptr", "idx", "val"))
        if len(cols) == 0:
            continue
        owner = np.repeat(np.arange(b.num_rows), np.diff(co))
        at = np.arange(len(cols)) + owner      # a block has one pointer more than columns
        first, last = ptr[at], ptr[at + 1]
        yield pa.RecordBatch.from_arrays([
            b.column("bi").take(pa.array(owner)), b.column("bj").take(pa.array(owner)), pa.array(cols, pa.int32()),
            pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(last - first, pa.int32()),
            pa.array(idx[io[owner] + first], pa.int32()), pa.array(np.add.reduceat(val, io[owner] + first), pa.float64())],
            ["bi", "bj", "col", "first", "last", "nnz", "first_row", "total"])


def block_columns(blocks: DataFrame) -> DataFrame:
    """The compressed columns as rows ``(bi, bj, col, first, last, nnz, first_row, total)``: the pointers of
    every stored column, its first row and the sum of its values."""
    return blocks.select("bi", "bj", "cols", "ptr", "idx", "val").mapInArrow(
        _columns, "bi long, bj long, col int, first int, last int, nnz int, first_row int, total double")
