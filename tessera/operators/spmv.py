"""Sparse matrix times vector, ``y(i) = sum_j A(i, j) x(j)``, in four layouts.

All layouts take general (already expanded) entries ``(by..., i, j, v)`` and a
vector ``(by..., i, x)`` and return ``(by..., i, x)`` with one row per non-empty
matrix row. They differ in how the work is grouped:

* ``join``    - every entry meets ``x(j)`` by an equi-join, then one keyed sum.
                One Catalyst plan: broadcast (or shuffled hash) join -> partial agg
                -> exchange(i) -> agg.
* ``packed``  - rows packed into sorted segments of at most ``width`` entries,
                ``x`` packed into dense blocks of ``width`` values; a segment meets
                its block by a join on the block number and is reduced with a
                higher-order ``aggregate`` (JVM side).
* ``blocked`` - entries grouped in tiles (column block x hash chunk of rows)
                whose size is bounded from per-block counts; each tile and its
                slice of ``x`` go to a numpy kernel through Arrow (cogroup).
* ``graph``   - edges ``(src, dst, attr)`` send ``attr * x(dst)`` to ``src``.

The ``grid`` layout (compressed blocks) is in ``blocks``, the routed graph in ``routing``.

Scale notes. A hot row (many entries with one ``i``) is harmless: the sum is
partially aggregated before the shuffle. A hot column only matters when ``x``
is not broadcast: the join is then a shuffled hash join built on the vector
side, and AQE's skew join splits the entries side, or, without AQE, hot columns are salted. Segments and tiles never
hold more than a bounded number of entries, whatever the skew.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import block_of
from ..plans import hint_broadcast

DEFAULT_WIDTH = 4096          # indices per column block / row segment
DEFAULT_TILE_ENTRIES = 1 << 20  # target entries per blocked-layout tile


def _zero_like(df: DataFrame, column: str):
    return F.lit(0).cast(df.schema[column].dataType)


# ---------------------------------------------------------------- join layout
def multiply_join(entries: DataFrame, vec: DataFrame, *, broadcast: bool | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    xs = vec.select(*by, F.col("i").alias("j"), F.col("x"))
    joined = entries.join(hint_broadcast(xs, broadcast), on=[*by, "j"], how="left")
    prod = F.col("v") * F.coalesce(F.col("x"), _zero_like(vec, "x"))
    return joined.groupBy(*by, "i").agg(F.sum(prod).alias("x"))


def salted(entries: DataFrame, hot: dict[int, int], total: int, parts: int) -> tuple[DataFrame, DataFrame | None]:
    """``(entries with s, copies)``: entries of hot columns dealt over salts ``s``, 0 elsewhere.

    ``hot``: entries per hot column, ``total`` of all. A column gets one salt per eighth of
    the share of a partition (``total / parts``); ``copies (j, k)`` says how many, and has at most
    one row per hot column. The salt depends on the entry alone, so a task that is run again
    sends it to the same place. Without hot columns there are no copies."""
    if not hot:
        return entries.withColumn("s", F.lit(0).cast("long")), None
    rows = [(int(j), max(1, -(-8 * n * parts // max(1, total)))) for j, n in sorted(hot.items())]
    copies = F.broadcast(entries.sparkSession.createDataFrame(rows, "j long, k long"))
    dealt = entries.join(copies, "j", "left").withColumn(
        "s", F.when(F.col("k").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("i", "v"), F.col("k"))).cast("long"))
    return dealt.drop("k"), copies


def multiply_join_salted(entries: DataFrame, vec: DataFrame, hot: dict[int, int], total: int, parts: int) -> DataFrame:
    """The join layout without a broadcast and without help from AQE: the entries of a hot column meet
    copies of its one vector value in several partitions; other columns are joined as they are."""
    dealt, copies = salted(entries, hot, total, parts)
    xs = vec.select(F.col("i").alias("j"), "x")
    if copies is None:
        xs = xs.withColumn("s", F.lit(0).cast("long"))
    else:
        xs = xs.join(copies, "j", "left").select(
            "j", "x", F.explode(F.expr("sequence(0L, coalesce(k, 1L) - 1)")).alias("s"))
    joined = dealt.join(hint_broadcast(xs, False), on=["j", "s"], how="left")
    prod = F.col("v") * F.coalesce(F.col("x"), _zero_like(vec, "x"))
    return joined.groupBy("i").agg(F.sum(prod).alias("x"))


# -------------------------------------------------------------- packed layout
def row_segments(entries: DataFrame, width: int = DEFAULT_WIDTH, by: Sequence[str] = ()) -> DataFrame:
    """Row segments ``(by..., i, s, e)``: the entries ``(j, v)`` of row ``i`` whose column
    lies in block ``s``, sorted by column. Expects canonical entries, so a segment
    holds at most ``width`` entries, and a row of any length is spread over
    ``n_cols / width`` segments instead of one unbounded array."""
    return (entries.withColumn("s", block_of("j", width))
            .groupBy(*by, "i", "s")
            .agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("e")))


def pack_rows(entries: DataFrame, width: int = DEFAULT_WIDTH, by: Sequence[str] = ()) -> DataFrame:
    """Row segments as ``(by..., i, s, idx, val)``; see ``row_segments``."""
    return row_segments(entries, width, by).select(*by, "i", "s", F.col("e.j").alias("idx"), F.col("e.v").alias("val"))


def cell_positions(cells: DataFrame, long_rows: dict[int, int] | None = None, width: int = DEFAULT_WIDTH) -> DataFrame:
    """``(i, pos, j, v)`` of unique cells, ``pos`` = the cell's 0-based place in its row (by column).

    Rows are numbered by one window over ``(i, s)``, the one exchange of cells. ``s`` is 0 but in
    the listed long rows, where it is the column block: a long row is numbered block by
    block by different tasks, and the cells before each block come from a running sum over
    the block counts of the long rows alone."""
    def numbered(by: list[str]):
        return (F.row_number().over(Window.partitionBy(*by).orderBy("j")) - 1).cast("long")

    if not long_rows:
        return cells.select("i", numbered(["i"]).alias("pos"), "j", "v")
    listed = F.broadcast(cells.sparkSession.createDataFrame([(int(i),) for i in sorted(long_rows)], "i long").withColumn("long", F.lit(True)))
    marked = cells.join(listed, "i", "left").withColumn(
        "s", F.when(F.col("long"), block_of("j", width)).otherwise(F.lit(0).cast("long"))).drop("long")
    counts = cells.join(listed, "i").groupBy("i", block_of("j", width).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("i").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("i", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("off"))
    placed = marked.withColumn("p", numbered(["i", "s"])).join(offsets, ["i", "s"], "left")
    return placed.select("i", (F.col("p") + F.coalesce("off", F.lit(0))).cast("long").alias("pos"), "j", "v")


def row_positions(segments: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Explode row segments to ``(by..., i, pos, j, v)``, ``pos`` = the entry's 0-based
    place in its whole row (ordered by column).

    Segment offsets come from a running sum over a one-row-per-segment table
    (the window sees segment sizes only), joined back on the unique ``(i, s)``
    key, so a long row is exploded by the tasks that hold its segments, not by
    one task. The segments are read twice: for cells that are not packed yet use
    ``cell_positions``. Packed rows (``idx``, ``val``) are taken as well."""
    if "e" not in segments.columns:
        cell = F.zip_with("idx", "val", lambda j, v: F.struct(j.alias("j"), v.alias("v")))
        segments = segments.select(*by, "i", "s", cell.alias("e"))
    before = Window.partitionBy(*by, "i").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = segments.select(*by, "i", "s", F.size("e").alias("n")).select(
        *by, "i", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("off"))
    z = segments.join(offsets, on=[*by, "i", "s"]).select(*by, "i", "off", F.posexplode("e").alias("p", "t"))
    return z.select(*by, "i", (F.col("off") + F.col("p")).alias("pos"),
                    F.col("t.j").alias("j"), F.col("t.v").alias("v"))


def vector_blocks(dense_vec: DataFrame, width: int = DEFAULT_WIDTH,
                  by: Sequence[str] = ()) -> DataFrame:
    """Dense blocks ``(by..., s, xb)`` of a dense vector: ``xb[k] = x(s * width + k)``."""
    return (dense_vec.withColumn("s", block_of("i", width))
            .groupBy(*by, "s")
            .agg(F.array_sort(F.collect_list(F.struct("i", F.col("x").cast("double").alias("x"))))
                 .alias("b"))
            .select(*by, "s", F.col("b.x").alias("xb")))


def multiply_packed(packed: DataFrame, blocks: DataFrame, width: int = DEFAULT_WIDTH, *,
                    broadcast: bool | None = None, by: Sequence[str] = ()) -> DataFrame:
    joined = packed.join(hint_broadcast(blocks, broadcast), on=[*by, "s"], how="left")
    base = F.col("s") * F.lit(int(width))

    def step(acc, t):
        xv = F.get(F.col("xb"), (t["idx"] - base).cast("int"))
        return acc + t["val"] * F.coalesce(xv, F.lit(0.0))

    part = F.aggregate(F.arrays_zip("idx", "val"), F.lit(0.0), step)
    return (joined.select(*by, "i", part.alias("p"))
            .groupBy(*by, "i").agg(F.sum("p").alias("x")))


# ------------------------------------------------------------- blocked layout
def _tile_kernel(width: int, by: Sequence[str]):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        out_cols = {k: [] for k in by}
        if left.num_rows == 0:
            return pa.table({**{k: pa.array([], left.schema.field(k).type) for k in by},
                             "i": pa.array([], pa.int64()), "x": pa.array([], pa.float64())})
        base = int(left.column("s")[0].as_py()) * width
        xb = np.zeros(width, dtype=np.float64)
        if right.num_rows:
            o = right.column("o").to_numpy() - base
            xb[o] = right.column("x").to_numpy(zero_copy_only=False)
        i = left.column("i").to_numpy()
        j = left.column("j").to_numpy() - base
        v = left.column("v").to_numpy(zero_copy_only=False)
        rows, inv = np.unique(i, return_inverse=True)
        sums = np.bincount(inv, weights=v * xb[j], minlength=rows.size)
        for k in by:
            out_cols[k] = pa.array([left.column(k)[0].as_py()] * rows.size, left.schema.field(k).type)
        return pa.table({**out_cols, "i": pa.array(rows, pa.int64()), "x": pa.array(sums, pa.float64())})

    return kernel


def tile_entries(entries: DataFrame, width: int = DEFAULT_WIDTH, target: int = DEFAULT_TILE_ENTRIES, *,
                 few_blocks: bool = False, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Canonical entries with their tile ``(s, c)``, and the chunks ``k`` per block ``(s, k)``.

    A column block with ``c`` stored entries is cut into ``ceil(c / target)`` chunks by
    a hash of the row index, so a hot column is spread over many tiles. The counts come
    from the entries as given (duplicates included: an upper bound), by a partial
    aggregate over the scan, so they cost no shuffle of entries; duplicates are then
    summed (map-side combined) by the one exchange on ``(i, j)``. ``few_blocks``: the
    caller has proven that the count table may be broadcast; else Spark chooses.
    """
    counts = (entries.select(*by, block_of("j", width).alias("s"))
              .groupBy(*by, "s").agg(F.count(F.lit(1)).alias("n"))
              .select(*by, "s", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(target)))
                      .cast("long").alias("k")))
    canon = entries.groupBy(*by, "i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    counts = F.broadcast(counts) if few_blocks else counts
    tagged = (canon.withColumn("s", block_of("j", width)).join(counts, on=[*by, "s"])
              .withColumn("c", F.pmod(F.xxhash64("i"), F.col("k")))
              .drop("k"))
    return tagged, counts


def multiply_blocked(tagged: DataFrame, counts: DataFrame, vec: DataFrame, *,
                     width: int = DEFAULT_WIDTH, by: Sequence[str] = ()) -> DataFrame:
    """Tiles (see ``tile_entries``) times the matching slice of ``x``.

    The block's stored values of ``x`` (at most ``width``, one per index) are copied to
    each of its chunks; the kernel fills the others with 0. A tile holds about
    ``target + width`` distinct cells. ``counts`` has at most ``n_cols / width`` rows.
    """
    xrep = (vec.select(*by, F.col("i").alias("o"), F.col("x").cast("double").alias("x"),
                       block_of("i", width).alias("s"))
            .join(counts, on=[*by, "s"])
            .withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
            .drop("k"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in tagged.schema.fields
                        if f.name in by] + ["i bigint", "x double"])
    partial = (tagged.groupBy(*by, "s", "c")
               .cogroup(xrep.groupBy(*by, "s", "c"))
               .applyInArrow(_tile_kernel(width, list(by)), schema))
    return partial.groupBy(*by, "i").agg(F.sum("x").alias("x"))


# --------------------------------------------------------------- graph layout
def graph_edges(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return entries.select(*by, F.col("i").alias("src"), F.col("j").alias("dst"),
                          F.col("v").alias("attr"))


def graph_vertices(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Every row id and every column id, once, with vertex attribute 0.0."""
    ids = edges.select(*by, F.col("src").alias("id")).unionByName(
        edges.select(*by, F.col("dst").alias("id")))
    return ids.distinct().withColumn("attr", F.lit(0.0))


def multiply_graph(edges: DataFrame, vec: DataFrame, *, broadcast: bool | None = None,
                   by: Sequence[str] = ()) -> DataFrame:
    """Aggregate messages ``attr * x(dst)`` at their source vertex."""
    vals = vec.select(*by, F.col("i").alias("dst"), F.col("x").alias("xd"))
    msgs = edges.join(hint_broadcast(vals, broadcast), on=[*by, "dst"], how="left")
    msg = F.col("attr") * F.coalesce(F.col("xd"), _zero_like(vec, "x"))
    return (msgs.groupBy(*by, "src").agg(F.sum(msg).alias("x"))
            .withColumnRenamed("src", "i"))
