"""Partitions of equal entry counts, positions in rows, and heavy keys.

``nnz_cuts`` finds the cells at which a matrix, read in (row, column) order, splits into
``parts`` runs whose sizes differ by at most one cell. Nothing is sorted as a whole:

1. cells per row, and an exclusive running sum over the rows in two levels (sums of at
   most ``BLOCKS`` row blocks, then rows inside one block), so no window sees more than
   ``BLOCKS`` blocks or the rows of one block;
2. a row that holds a cut inside it (at most ``parts - 1`` of them) is counted by column
   block in the same way, so a row larger than a share is cut by column;
3. only the column blocks that hold a cut are ordered cell by cell.

Every row or block finds the cuts inside it from its own running sum, so no join pairs
rows with cuts. The driver gets one row per part, and no other data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import block_of

BLOCKS = 1 << 16         # blocks per level of a running sum
MAX_PARTS = 1 << 20      # cuts are held by the driver and sent to each task
LONG_ROW = 1 << 16       # a row of fewer cells is always ordered by one task
MAX_LONG = 1 << 12       # long rows and hot columns listed at once
SKETCH_KEYS = 1 << 15    # keys that the heavy-key sketch tracks
LEAST_SHARE = 1 / 2048   # smallest share of the rows that makes a key heavy


def running_counts(counts: DataFrame, key: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """``counts (by..., key, n)`` with ``before``, the sum of ``n`` over smaller keys (of the same
    ``by``), and ``total``, the sum of all. Keys are unique, in ``0 .. size-1``."""
    width = max(-(-int(size) // BLOCKS), math.isqrt(int(size)) + 1)
    marked = counts.withColumn("blk", block_of(key, width))
    # without other keys one window over the blocks is meant: there are at most BLOCKS of them
    group = [*by] or [F.lit(0)]
    blocks = marked.groupBy(*by, "blk").agg(F.sum("n").alias("blk_n"))
    order = Window.partitionBy(*group).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    blocks = blocks.select(*by, "blk", F.coalesce(F.sum("blk_n").over(order), F.lit(0)).alias("blk_before"),
                           F.sum("blk_n").over(whole).alias("total"))
    inside = Window.partitionBy(*by, "blk").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inner = marked.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    return (inner.join(blocks if by else F.broadcast(blocks), [*by, "blk"])
            .select(*counts.columns, (F.col("blk_before") + F.col("inner")).cast("long").alias("before"),
                    F.col("total").cast("long").alias("total")))


def _cuts_inside(start: str, n: str, total: str | int, parts: int) -> Column:
    """The parts 1.. whose first cell has a rank in ``start .. start + n - 1`` (none: null)."""
    low = f"CASE WHEN {start} = 0 THEN 1 ELSE ({start} - 1) * {parts} div {total} + 1 END"
    high = f"({start} + {n} - 1) * {parts} div {total}"
    return F.expr(f"CASE WHEN {high} >= {low} THEN sequence({low}, {high}) END")


def _first_rank(k: str, total: str | int, parts: int) -> Column:
    return F.expr(f"({k} * {total} + {parts - 1}) div {parts}")


@dataclass
class Cuts:
    """First cells of parts ``1 ..`` in (row, column) order: row, column (-1: the row's start),
    and how many cells of that row lie before. Parts after the last cell have no cut."""

    parts: int
    total: int
    i: np.ndarray
    j: np.ndarray
    before: np.ndarray

    def part_of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The part of cells: how many cuts are not after them."""
        low = np.searchsorted(self.i, i, side="left")
        high = np.searchsorted(self.i, i, side="right")
        while True:  # bisect the columns of the cuts of the cell's own row
            open_ = np.nonzero(low < high)[0]
            if len(open_) == 0:
                return low
            mid = (low[open_] + high[open_]) // 2
            right = self.j[mid] <= j[open_]
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]


def nnz_cuts(cells: DataFrame, n_rows: int, n_cols: int, parts: int) -> Cuts:
    """Cuts of unique cells ``(i, j, ...)``; read two or three times, so keep them if they cost much.

    The cell of rank r (in row, column order) goes to part ``r * parts div total``."""
    if not 0 < parts <= MAX_PARTS:
        raise ValueError(f"parts must lie in 1..{MAX_PARTS}")
    spark = cells.sparkSession
    rows = running_counts(cells.groupBy("i").agg(F.count(F.lit(1)).alias("n")), "i", n_rows)
    held = rows.select("i", "before", "total", F.explode(_cuts_inside("before", "n", "total", parts)).alias("k"))
    found = held.select("i", "before", "total", "k", (_first_rank("k", "total", parts) - F.col("before")).alias("q")).collect()
    total = found[0]["total"] if found else cells.count()   # one part, or no cells
    if total * parts >= 1 << 63:
        raise ValueError("cells times parts must stay below 2**63")
    cut = {r["k"]: (r["i"], -1, r["q"]) for r in found}
    inside = {r["i"]: r["before"] for r in found if r["q"] > 0}
    if inside:
        cut.update(_column_cuts(spark, cells, inside, total, n_cols, parts))
    cols = [np.array(c, np.int64) for c in zip(*(cut[k] for k in sorted(cut)))] if cut else [np.zeros(0, np.int64)] * 3
    return Cuts(parts, total, *cols)


def _column_cuts(spark, cells: DataFrame, rows: dict[int, int], total: int, n_cols: int, parts: int) -> dict[int, tuple]:
    """``part: (row, column, cells of the row before it)`` of the cuts inside the given rows (row: its first rank)."""
    width = max(1, -(-int(n_cols) // BLOCKS))
    listed = F.broadcast(spark.createDataFrame(list(rows.items()), "i long, row_start long"))
    mine = cells.select("i", "j").join(listed, "i").withColumn("jb", block_of("j", width))
    counted = running_counts(mine.groupBy("i", "row_start", "jb").agg(F.count(F.lit(1)).alias("n")), "jb",
                             -(-int(n_cols) // width), by=["i", "row_start"])
    held = counted.select("i", "row_start", "jb", (F.col("row_start") + F.col("before")).alias("start"), "n").withColumn(
        "ks", _cuts_inside("start", "n", total, parts)).where("ks is not null")
    if width == 1:   # a block is a column
        found = held.select("i", "row_start", F.col("jb").alias("j"), F.col("start").alias("rank"), "ks")
    else:
        blocks = F.broadcast(held.select("i", "jb", "start"))
        place = F.row_number().over(Window.partitionBy("i", "jb").orderBy("j")) - 1
        found = (mine.join(blocks, ["i", "jb"]).select("i", "row_start", "j", (F.col("start") + place).alias("rank"))
                 .withColumn("ks", _cuts_inside("rank", "1", total, parts)).where("ks is not null"))
    return {k: (r["i"], r["j"], r["rank"] - r["row_start"]) for r in found.collect() for k in r["ks"]}


def with_part(cells: DataFrame, cuts: Cuts) -> DataFrame:
    """``cells`` with ``part int``, looked up in the broadcast cuts (one bisection per cell)."""
    held = cells.sparkSession.sparkContext.broadcast(cuts)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cells.schema.fields), "part int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = held.value.part_of(b.column("i").to_numpy(), b.column("j").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], [*b.schema.names, "part"])

    return cells.mapInArrow(run, schema)


def balanced(cells: DataFrame, cuts: Cuts) -> DataFrame:
    """``cells`` with ``part``; Spark partition k holds part k, sorted by row and column."""
    return with_part(cells, cuts).repartitionById(cuts.parts, "part").sortWithinPartitions("i", "j")


def part_positions(parts: DataFrame, cuts: Cuts) -> DataFrame:
    """``(i, pos, j, v)`` from ``balanced`` cells by one scan of every part: ``pos`` is the cell's
    place in its row. A row that continues from earlier parts starts at its cut's count."""
    held = parts.sparkSession.sparkContext.broadcast(cuts)
    value = parts.schema["v"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, at = None, 0     # the open row and its next position
        for b in batches:
            if b.num_rows == 0:
                continue
            i = b.column("i").to_numpy()
            if row is None:
                k = b.column("part")[0].as_py() - 1
                row, at = int(i[0]), int(held.value.before[k]) if k >= 0 and held.value.i[k] == i[0] else 0
            new = np.r_[True, i[1:] != i[:-1]]
            first = np.nonzero(new)[0]
            pos = np.arange(len(i)) - first[np.cumsum(new) - 1]
            if i[0] == row:
                pos[:first[1] if len(first) > 1 else len(i)] += at
            row, at = int(i[-1]), int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(pos, pa.int64()), b.column("j"), b.column("v")], ["i", "pos", "j", "v"])

    return parts.mapInArrow(run, f"i long, pos long, j long, v {value}")


# -------------------------------------------------------------- heavy keys
def heavy_keys(df: DataFrame, key: str, share: float) -> tuple[dict[int, int], int]:
    """``({key: count}, rows)``: every key that holds at least ``share`` of the rows (others may be listed too).

    A frequent-items sketch (map-side, merged) of ``SKETCH_KEYS`` keys: a count is at most
    3.5 / SKETCH_KEYS of the rows off, and at most ``MAX_LONG`` keys are listed, so ``share`` is at
    least ``LEAST_SHARE``. One pass over the key column; null keys do not count."""
    slack = 3.5 / SKETCH_KEYS
    if not LEAST_SHARE <= share <= 1:
        raise ValueError(f"share must lie in {LEAST_SHARE}..1")
    row = df.agg(F.expr(f"approx_top_k(`{key}`, {MAX_LONG}, {SKETCH_KEYS})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    least = (share - slack) * row["n"]
    return {t["item"]: t["count"] for t in row["top"] or () if t["item"] is not None and t["count"] >= least}, row["n"]
