"""Inline fixtures F1-F14 of FIXTURES.md, every layout where it applies."""

import pytest

from conftest import dense_values, mat, sparse_vec, vec
from tessera import LAYOUTS, MatrixFrame, VectorFrame

NON_GRAPH = [lay for lay in LAYOUTS if lay != "graph"]


@pytest.mark.parametrize("layout", NON_GRAPH)
def test_f1_rectangular(spark, layout):
    a = mat(spark, [(0, 0, 1), (0, 2, 2), (2, 1, 3)], 4, 3)
    y = a.multiply(vec(spark, [1, 2, 3]), layout=layout)
    assert y.length == 4
    assert dense_values(y) == [7, 0, 6, 0]


@pytest.mark.parametrize("layout", NON_GRAPH)
def test_f2_transpose(spark, layout):
    a = mat(spark, [(0, 0, 1), (0, 2, 2), (2, 1, 3)], 4, 3)
    y = a.multiply(vec(spark, [1, 2, 3, 4]), trans=True, layout=layout)
    assert y.length == 3
    assert dense_values(y) == [1, 9, 2]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_f3_symmetric_no_diagonal(spark, layout):
    s = mat(spark, [(1, 0, 2), (2, 2, 5)], 3, 3, "symmetric")
    assert dense_values(s.multiply(vec(spark, [1, 1, 1]), layout=layout)) == [2, 2, 5]
    assert dense_values(s.multiply(vec(spark, [1, 1, 1]), trans=True, layout=layout)) == [2, 2, 5]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_f4_duplicates(spark, layout):
    d = mat(spark, [(0, 0, 1), (0, 0, 2), (1, 1, 4)], 2, 2)
    assert dense_values(d.multiply(vec(spark, [10, 1]), layout=layout)) == [30, 4]
    cells = {(r.i, r.j): r.v for r in d.to_dense().collect()}
    assert cells == {(0, 0): 3.0, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 4.0}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_f5_skew(spark, layout):
    k = mat(spark, [(1, 0, 2), (2, 1, -3)], 3, 3, "skew-symmetric")
    assert dense_values(k.multiply(vec(spark, [1, 2, 3]), layout=layout)) == [-4, 11, -6]
    assert dense_values(k.multiply(vec(spark, [1, 2, 3]), trans=True, layout=layout)) == [4, -11, 6]


def test_f5b_skew_stored_diagonal_cancels(spark):
    k = mat(spark, [(1, 0, 2), (2, 1, -3), (1, 1, 9)], 3, 3, "skew-symmetric")
    assert dense_values(k.multiply(vec(spark, [1, 2, 3]))) == [-4, 11, -6]
    assert k.diagonal().df.count() == 0


def test_f6_pattern(spark):
    df = spark.createDataFrame([(0, 1), (1, 0), (1, 1)], "r long, c long")
    p = MatrixFrame.from_df(df, "r", "c", v=None, n_rows=2, n_cols=2)
    assert dense_values(p.multiply(vec(spark, [5, 7]))) == [7, 12]


def test_f7_explicit_zero(spark):
    z = mat(spark, [(0, 0, 0), (1, 1, 2)], 2, 2)
    y = z.multiply(vec(spark, [1, 1]))
    assert dense_values(y) == [0, 2]
    assert z.stored_count() == 2
    assert z.nnz() == 1
    assert y.active_size() == 2


def test_f8_empty_with_shape(spark):
    e = MatrixFrame(spark.createDataFrame([], "i long, j long, v double"), 3, 2)
    y = e.multiply(vec(spark, [1, 1]))
    assert y.df.count() == 0
    assert dense_values(y) == [0, 0, 0]


def test_f8_empty_without_shape_is_an_error(spark):
    e = MatrixFrame(spark.createDataFrame([], "i long, j long, v double"))
    with pytest.raises(ValueError, match="empty matrix"):
        _ = e.shape


def test_f9_bad_input(spark):
    a = mat(spark, [(0, 0, 1)], 2, 2)
    with pytest.raises(ValueError, match="length"):
        a.multiply(vec(spark, [1, 2, 3]))
    with pytest.raises(ZeroDivisionError):
        vec(spark, [1, 2]) / 0
    with pytest.raises(ValueError, match="square"):
        mat(spark, [(0, 0, 1)], 2, 3).multiply(vec(spark, [1, 1, 1]), layout="graph")
    with pytest.raises(ValueError, match="symmetry"):
        mat(spark, [(0, 0, 1)], 2, 2, "sideways")
    with pytest.raises(ValueError, match="layout"):
        a.multiply(vec(spark, [1, 1]), layout="csr")
    with pytest.raises(ValueError, match="lengths differ"):
        vec(spark, [1, 2]).dot(vec(spark, [1, 2, 3]))


def test_f11_big_index(spark):
    a = mat(spark, [(3_000_000_000, 5_000_000_000, 1.5)], 3_000_000_001, 5_000_000_001)
    x = sparse_vec(spark, [(5_000_000_000, 2.0)], 5_000_000_001)
    rows = a.multiply(x).df.collect()
    assert [(r.i, r.x) for r in rows] == [(3_000_000_000, 3.0)]
    rows_t = a.multiply(sparse_vec(spark, [(3_000_000_000, 2.0)], 3_000_000_001), trans=True).df.collect()
    assert [(r.i, r.x) for r in rows_t] == [(5_000_000_000, 3.0)]


def test_f12_dot_scale(spark):
    x = sparse_vec(spark, [(0, 1), (2, 3)], 3)
    y = sparse_vec(spark, [(0, 2), (1, 5), (2, 4)], 3)
    assert x.dot_value(y) == 14.0
    assert dense_values(y / 2) == [1, 2.5, 2]
    assert abs(y.norm_value() - (4 + 25 + 16) ** 0.5) < 1e-12
    assert dense_values(x + y) == [3, 5, 7]
    assert dense_values(x - y) == [-1, -5, -1]
    assert dense_values(x.multiply(y)) == [2, 0, 12]


def test_f14_scatter_add(spark):
    v = sparse_vec(spark, [(0, 1), (0, 2), (2, 5)], 4)
    assert dense_values(v) == [3, 0, 5, 0]
    assert v.canonical().df.count() == 2


def test_random_vector_is_deterministic_and_normal(spark):
    a = VectorFrame.random_normal(spark, 20000, seed=7)
    b = VectorFrame.random_normal(spark, 20000, seed=7)
    b.df = b.df.repartition(3)
    va = {r.i: r.x for r in a.df.collect()}
    vb = {r.i: r.x for r in b.df.collect()}
    assert va == vb
    import statistics

    vals = list(va.values())
    assert abs(statistics.mean(vals)) < 0.05
    assert abs(statistics.pstdev(vals) - 1.0) < 0.05


def test_symmetry_kinds(spark):
    assert mat(spark, [(1, 0, 2), (2, 2, 5)], 3, 3, "symmetric").symmetry_kind().first()["kind"] == "symmetric"
    assert mat(spark, [(1, 0, 2)], 3, 3, "skew-symmetric").symmetry_kind().first()["kind"] == "skew-symmetric"
    assert mat(spark, [(1, 0, 2)], 3, 3).symmetry_kind().first()["kind"] == "general"
    assert mat(spark, [(0, 0, 2)], 3, 2).symmetry_kind().first()["kind"] == "general"


def test_lower_upper_diagonal(spark):
    s = mat(spark, [(1, 0, 2), (2, 2, 5)], 3, 3, "symmetric")
    low = {(r.i, r.j): r.v for r in s.lower().entries.collect()}
    assert low == {(1, 0): 2.0, (2, 2): 5.0}
    up = {(r.i, r.j): r.v for r in s.upper(strict=True).entries.collect()}
    assert up == {(0, 1): 2.0}
    assert dense_values(s.diagonal()) == [0, 0, 5]


def test_packed_rows_segments(spark):
    a = mat(spark, [(0, c, float(c)) for c in range(10)] + [(1, 3, 1.0)], 2, 10)
    rows = a.indexed_rows(width=4).orderBy("i", "s").collect()
    assert [(r.i, r.s, r.idx) for r in rows] == [
        (0, 0, [0, 1, 2, 3]), (0, 1, [4, 5, 6, 7]), (0, 2, [8, 9]), (1, 0, [3])]
    assert all(r.size == 10 for r in rows)
    y = a.multiply(vec(spark, [1] * 10), layout="packed", width=4)
    assert dense_values(y) == [45, 1]


def test_graph_vertices_include_isolated_destinations(spark):
    g = mat(spark, [(0, 2, 1.0)], 3, 3)
    vertices, edges = g.graph()
    assert sorted(r.id for r in vertices.collect()) == [0, 2]
    assert edges.columns == ["src", "dst", "attr"]


def test_row_positions_across_segments(spark):
    from tessera.operators.spmv import row_positions

    a = mat(spark, [(0, c, float(c)) for c in range(9, -1, -1)] + [(1, 3, 1.0), (1, 9, 2.0)], 2, 10)
    rows = row_positions(a.indexed_rows(width=4).drop("size")).collect()
    got = sorted((r.i, r.pos, r.j, r.v) for r in rows)
    want = [(0, c, c, float(c)) for c in range(10)] + [(1, 0, 3, 1.0), (1, 1, 9, 2.0)]
    assert got == want


def test_decimal_values_stay_exact(spark):
    from decimal import Decimal

    df = spark.createDataFrame([(0, 0, Decimal("0.10")), (0, 1, Decimal("0.20")), (1, 1, Decimal("0.30"))],
                               "i long, j long, v decimal(15,2)")
    a = MatrixFrame.from_df(df, n_rows=2, n_cols=2)
    x = VectorFrame(spark.createDataFrame([(0, Decimal("0.10")), (1, Decimal("0.20"))],
                                          "i long, x decimal(15,2)"), 2, True)
    for layout in ("join", "graph"):
        y = {r.i: r.x for r in a.multiply(x, layout=layout).df.collect()}
        assert y == {0: Decimal("0.0500"), 1: Decimal("0.0600")}, layout
    assert a.multiply(x).df.schema["x"].dataType.typeName() == "decimal"


@pytest.mark.parametrize("layout", LAYOUTS)
def test_nan_propagates(spark, layout):
    import math

    a = mat(spark, [(0, 0, float("nan")), (0, 1, 1.0), (1, 1, 2.0)], 2, 2)
    y = {r.i: r.x for r in a.multiply(vec(spark, [1, 1]), layout=layout).df.collect()}
    assert math.isnan(y[0]) and y[1] == 2.0


def test_reference_layout_names(spark):
    a = mat(spark, [(0, 0, 1), (0, 2, 2), (2, 1, 3)], 4, 3)
    for name in ("COO", "csc", "Join"):
        assert dense_values(a.multiply(vec(spark, [1, 2, 3]), layout=name)) == [7, 0, 6, 0]
    with pytest.raises(ValueError, match="unknown layout"):
        a.multiply(vec(spark, [1, 2, 3]), layout="CSR")


def test_hermitian_real_storage_is_symmetric(spark):
    h = mat(spark, [(1, 0, 2), (2, 2, 5)], 3, 3, "hermitian")
    s = mat(spark, [(1, 0, 2), (2, 2, 5)], 3, 3, "symmetric")
    for layout in LAYOUTS:
        assert dense_values(h.multiply(vec(spark, [1, 2, 3]), layout=layout)) == \
            dense_values(s.multiply(vec(spark, [1, 2, 3]), layout=layout)) == [4, 2, 15]
    assert h.transpose() is h
