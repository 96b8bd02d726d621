"""Named queries over the driver tables: one per operator of the inventory.

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
whole tables. Floating results are rounded to a number of decimals at which the
exact answer is representable (inputs have two decimals), so two engines that
sum in different orders print the same numbers; grand totals use the exact
DECIMAL route instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import complex as cx
from ..matrix import MatrixFrame
from ..operators import structure as st
from ..operators.blocks import block_columns
from ..operators.partition import part_positions
from ..operators.power import power_iteration, power_method
from ..operators.repeat import repeat_multiply
from ..operators.routing import partition_sizes
from ..sources.tables import DriverTables
from ..vector import VectorFrame

Query = Callable[[SparkSession, str], DataFrame]


def _r(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    cols = cols or ("x",)
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _vec(y: VectorFrame, digits: int) -> DataFrame:
    return _r(y.df.select("i", F.col("x").cast("double").alias("x")), digits)


# ------------------------------------------------------------------ products
def spmv(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.li().multiply(t.px()), 4)


def spmv_dense(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.li().multiply(t.px()).to_dense(), 4)


def spmv_trans(spark, sf):
    """Per-part sums grow with the data: exact DECIMAL values, one rounding at the end."""
    t = DriverTables(spark, sf)
    return _vec(t.li(exact=True).multiply(t.ox(exact=True), trans=True), 4)


def spmv_pattern(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.ev().multiply(t.events_per_type()), 4)


def spmv_embedding(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.em().multiply(t.first_embedding()), 4)


def spmv_sym(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.sym().multiply(t.customers_per_nation()), 2)


def spmv_sym_trans(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.sym().multiply(t.customers_per_nation(), trans=True), 2)


def spmv_sym_nodiag(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.sym(diagonal=False).multiply(t.customers_per_nation()), 2)


def spmv_skew(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.skew().multiply(t.customers_per_nation()), 2)


def _layout(layout: str, kind: str) -> Query:
    def q(spark, sf):
        t = DriverTables(spark, sf)
        if kind == "plain":
            a, x, trans, d = (t.nt(), t.customers_per_nation(), False, 2) if layout == "graph" \
                else (t.li(), t.px(), False, 4)
        elif kind == "trans":
            a, x, trans, d = (t.nt(), t.customers_per_nation(), True, 2) if layout == "graph" \
                else (t.li(), t.ox(), True, 4)
        else:
            a, x, trans, d = t.sym(), t.customers_per_nation(), False, 2
        return _vec(a.multiply(x, trans=trans, layout=layout), d)

    q.__name__ = f"spmv_{layout}" + ("" if kind == "plain" else f"_{kind}")
    return q


def spmv_hot_row(spark, sf):
    """A quarter of the entries in row 0: summed map-side before the shuffle."""
    t = DriverTables(spark, sf)
    return _vec(t.li_hot("row").multiply(t.px(exact=True)), 4)


def spmv_hot_column_shuffled(spark, sf):
    """A quarter of the entries in column 0, vector not broadcast: shuffled hash join
    built on the vector side, skewed partitions split by AQE."""
    t = DriverTables(spark, sf)
    return _vec(t.li_hot("column").multiply(t.px(exact=True), broadcast=False), 4)


def spmv_hot_column_salted(spark, sf):
    """The same skew and no broadcast, without help from AQE: the hot column is found by a
    sketch and dealt over partitions."""
    t = DriverTables(spark, sf)
    return _vec(t.li_hot("column").multiply(t.px(exact=True), broadcast=False, salt=True), 4)


def spmv_grid_shuffled(spark, sf):
    """Compressed blocks against shuffled vector blocks, a chunk of a block column at a time."""
    t = DriverTables(spark, sf)
    return _vec(t.li().multiply(t.px(), layout="grid", broadcast=False), 4)


def _routed(trans: bool) -> Query:
    def q(spark, sf):
        t = DriverTables(spark, sf)
        return _vec(t.ps().multiply(t.part_supplier_values(), trans=trans, layout="routed"), 2)

    q.__name__ = "spmv_graph_routed" + ("_trans" if trans else "")
    return q


# ---------------------------------------------------------------- partitions
NNZ_PARTS, ROUTED_PARTS = 16, 16


def nnz_partitions(spark, sf):
    """Rows and cells of each of 16 partitions of equal counts; a quarter of the entries lie in row 0."""
    t = DriverTables(spark, sf)
    parts = t.li_hot("row").balanced_cells(NNZ_PARTS)
    return parts.groupBy("part").agg(F.countDistinct("i").alias("rows"), F.count(F.lit(1)).alias("nnz"))


def spmv_balanced(spark, sf):
    t = DriverTables(spark, sf)
    a = t.li()
    kept = MatrixFrame(a.balanced_cells(NNZ_PARTS).drop("part"), a.n_rows, a.n_cols, canonical=True)
    return _vec(kept.multiply(t.px()), 4)


def balanced_positions(spark, sf):
    """The row positions of all cells from one scan of each balanced partition."""
    a = DriverTables(spark, sf).li_hot("row")
    cuts = a.nnz_cuts(NNZ_PARTS)
    pos = part_positions(a.balanced_cells(NNZ_PARTS, cuts), cuts)
    return pos.select("i", "pos", "j", F.col("v").cast("double").alias("v"))


def grid_blocks(spark, sf):
    """Directory of the 1024 x 256 blocks: cells, stored columns, distinct rows."""
    blocks = DriverTables(spark, sf).li().grid_blocks(1024, 256)
    return blocks.select("bi", "bj", "nnz", F.size("cols").alias("n_cols"), F.size(F.array_distinct("idx")).alias("n_rows"),
                         F.get("ptr", F.size("ptr") - 1).alias("end"))


def csc_blocks(spark, sf):
    """Every stored column of the compressed blocks with its pointers."""
    return _r(block_columns(DriverTables(spark, sf).li().grid_blocks(1024, 256)), 2, "total")


def graph_routing(spark, sf):
    """Per edge partition: edges, vertices shipped to it, vertices it writes."""
    return partition_sizes(DriverTables(spark, sf).ps().edge_partitions(ROUTED_PARTS))


# ----------------------------------------------------------------- structure
def transpose(spark, sf):
    return DriverTables(spark, sf).li().transpose().entries


def diagonal(spark, sf):
    return _vec(DriverTables(spark, sf).nt().diagonal(), 2)


def lower_triangle(spark, sf):
    return DriverTables(spark, sf).nt().lower().entries


def sym_expand(spark, sf):
    return DriverTables(spark, sf).sym().expand().entries


def skew_expand(spark, sf):
    return DriverTables(spark, sf).skew().expand().entries


def canonicalize(spark, sf):
    return DriverTables(spark, sf).li().canonicalize().entries


def shape(spark, sf):
    return DriverTables(spark, sf).li().shape_frame()


def nnz(spark, sf):
    return st.nonzero_count(DriverTables(spark, sf).li().full_entries())


def active_size(spark, sf):
    t = DriverTables(spark, sf)
    y = t.li().multiply(t.px())
    return y.df.agg(F.count(F.lit(1)).alias("active_size"))


def indexed_rows(spark, sf):
    return DriverTables(spark, sf).li().indexed_entries(width=256)


def row_matrix(spark, sf):
    """Rows without their order: stored count and Euclidean norm of each non-empty row.
    The width is below the number of columns, so rows have several segments."""
    segments = DriverTables(spark, sf).li().row_matrix(width=256)
    sq = F.aggregate("val", F.lit(0.0), lambda a, t: a + t * t)
    per_row = segments.groupBy("row").agg(F.sum(F.size("idx")).cast("long").alias("nnz"),
                                          F.sqrt(F.sum(sq)).alias("norm"))
    return per_row.drop("row")


def to_dense(spark, sf):
    return _r(DriverTables(spark, sf).sym().to_dense(), 2, "v")


def scatter_add(spark, sf):
    t = DriverTables(spark, sf)
    li = t.table("lineitem").select(F.col("l_partkey").alias("i"), F.col("l_quantity").alias("x"))
    return _vec(VectorFrame(li, t.n_parts).to_dense(), 4)


def symmetry_kind(spark, sf):
    t = DriverTables(spark, sf)
    parts = []
    shapes = []
    for name, m in (("nt", t.nt()), ("sym", t.sym()), ("skew", t.skew())):
        parts.append(m.full_entries().withColumn("matrix_id", F.lit(name)))
        shapes.append((name, m.n_rows, m.n_cols))
    entries = parts[0].unionByName(parts[1]).unionByName(parts[2])
    shape_df = spark.createDataFrame(shapes, "matrix_id string, n_rows long, n_cols long")
    return st.symmetry_kind(entries, shape_df, by=["matrix_id"])


def graph_vertices(spark, sf):
    vertices, _ = DriverTables(spark, sf).nt().graph()
    return vertices


# ------------------------------------------------------------------ vectors
def vec_dot(spark, sf):
    px = DriverTables(spark, sf).px(exact=True)
    return px.dot(px).select(F.col("dot").cast("double").alias("dot"))


def vec_div(spark, sf):
    return (DriverTables(spark, sf).ox() / 7.0).df


def vec_norm(spark, sf):
    return DriverTables(spark, sf).px(exact=True).norm()


def vec_add(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.px() + t.part_size(), 4)


def vec_sub(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.px() - t.part_size(), 4)


def vec_mul(spark, sf):
    t = DriverTables(spark, sf)
    return _vec(t.px().multiply(t.part_size()), 4)


def residual(spark, sf):
    t = DriverTables(spark, sf)
    r = t.li().multiply(t.px()).residual(t.ox())
    return _r(r, 2, "max_abs", "norm2")


def random_vector(spark, sf):
    """One draw per part: all are there, no two are equal, and mean and deviation lie
    within four standard errors of 0 and 1."""
    t = DriverTables(spark, sf)
    draws = t.table("part").select(F.col("p_partkey").cast("long").alias("i")).join(
        VectorFrame.random_normal(spark, t.n_parts, seed=42).df, "i")
    n = F.count(F.lit(1))
    return draws.agg(n.alias("n"), F.countDistinct("x").alias("n_distinct"),
                     (F.abs(F.avg("x")) <= 4 / F.sqrt(n)).alias("mean_near"),
                     (F.abs(F.stddev_pop("x") - 1) <= 4 / F.sqrt(2 * n)).alias("deviation_near"))


def spmv_repeat(spark, sf):
    """The repeated product's operand form, built once, gives the plain product."""
    t = DriverTables(spark, sf)
    a = t.nt()
    repeat_multiply(a, t.customers_per_nation(), runs=2, layout="blocked")
    y = a.multiply(t.customers_per_nation(), layout="blocked")
    a.unprepare()
    return _vec(y, 2)


def power_step_3(spark, sf):
    t = DriverTables(spark, sf)
    a = t.sym()
    x0 = VectorFrame(spark.range(a.n_rows).select(F.col("id").alias("i"), F.lit(1.0).alias("x")),
                     a.n_rows, True)
    x, _ = power_iteration(a, x0, 3, checkpoint_every=None)
    return _vec(x, 8)


def power_converged(spark, sf):
    """The dominant eigenvalue of the symmetric trade matrix, to a residual of 1e-6."""
    t = DriverTables(spark, sf)
    a = t.sym()
    ones = VectorFrame(spark.range(a.n_rows).select(F.col("id").alias("i"), F.lit(1.0).alias("x")), a.n_rows, True)
    r = power_method(a, ones, tolerance=1e-6, max_steps=60)
    if not r.converged:
        raise AssertionError(f"no convergence: {r}")
    found = r.vector.df.agg(F.max(F.abs("x")).alias("largest"))
    return found.select(F.round(F.lit(r.eigenvalue), 3).alias("eigenvalue"), F.lit(r.steps).cast("long").alias("steps"),
                        F.round(F.lit(r.residual), 9).alias("residual"), F.round("largest", 8).alias("largest"))


# ------------------------------------------------------------------ complex
def complex_spmv(spark, sf):
    t = DriverTables(spark, sf)
    return _r(cx.multiply(t.li_complex(), t.px_complex()), 4, "x", "xi")


def hermitian_spmv(spark, sf):
    t = DriverTables(spark, sf)
    full = cx.expand(t.hermitian_trade(), "hermitian")
    return _r(cx.multiply(full, t.customers_per_nation().df), 2, "x", "xi")


def complex_kind(spark, sf):
    t = DriverTables(spark, sf)
    full = cx.expand(t.hermitian_trade(), "hermitian")
    return cx.describe(full, True)


QUERIES: dict[str, Query] = {
    "spmv": spmv,
    "spmv_dense": spmv_dense,
    "spmv_trans": spmv_trans,
    "spmv_pattern": spmv_pattern,
    "spmv_embedding": spmv_embedding,
    "spmv_sym": spmv_sym,
    "spmv_sym_trans": spmv_sym_trans,
    "spmv_sym_nodiag": spmv_sym_nodiag,
    "spmv_skew": spmv_skew,
    "spmv_hot_row": spmv_hot_row,
    "spmv_hot_column_shuffled": spmv_hot_column_shuffled,
    **{f"spmv_{lay}" + ("" if k == "plain" else f"_{k}"): _layout(lay, k)
       for lay in ("packed", "blocked", "graph", "grid") for k in ("plain", "trans", "sym")},
    "spmv_hot_column_salted": spmv_hot_column_salted,
    "spmv_grid_shuffled": spmv_grid_shuffled,
    "spmv_graph_routed": _routed(False),
    "spmv_graph_routed_trans": _routed(True),
    "nnz_partitions": nnz_partitions,
    "spmv_balanced": spmv_balanced,
    "balanced_positions": balanced_positions,
    "grid_blocks": grid_blocks,
    "csc_blocks": csc_blocks,
    "graph_routing": graph_routing,
    "transpose": transpose,
    "diagonal": diagonal,
    "lower_triangle": lower_triangle,
    "sym_expand": sym_expand,
    "skew_expand": skew_expand,
    "canonicalize": canonicalize,
    "shape": shape,
    "nnz": nnz,
    "active_size": active_size,
    "indexed_rows": indexed_rows,
    "row_matrix": row_matrix,
    "to_dense": to_dense,
    "scatter_add": scatter_add,
    "symmetry_kind": symmetry_kind,
    "graph_vertices": graph_vertices,
    "vec_dot": vec_dot,
    "vec_div": vec_div,
    "vec_norm": vec_norm,
    "vec_add": vec_add,
    "vec_sub": vec_sub,
    "vec_mul": vec_mul,
    "residual": residual,
    "random_vector": random_vector,
    "spmv_repeat": spmv_repeat,
    "power_step_3": power_step_3,
    "power_converged": power_converged,
    "complex_spmv": complex_spmv,
    "hermitian_spmv": hermitian_spmv,
    "complex_kind": complex_kind,
}
