"""Algebraic properties on seeded random matrices, and equality of the four layouts."""

import random

import pytest

from conftest import mat
from tessera import LAYOUTS, VectorFrame


def _random(spark, seed, n_rows, n_cols, nnz, dup=True, symmetry="general"):
    rnd = random.Random(seed)
    triples = []
    for _ in range(nnz):
        i, j = rnd.randrange(n_rows), rnd.randrange(n_cols)
        if symmetry != "general" and i < j:
            i, j = j, i
        triples.append((i, j, round(rnd.uniform(-10, 10), 3)))
    if dup:
        triples += triples[: nnz // 10]
    return mat(spark, triples, n_rows, n_cols, symmetry)


def _rvec(spark, seed, n, density=1.0):
    rnd = random.Random(seed)
    rows = [(i, round(rnd.uniform(-5, 5), 3)) for i in range(n) if rnd.random() < density]
    return VectorFrame(spark.createDataFrame(rows, "i long, x double"), n, unique=True)


def _as_dict(v):
    return {r.i: r.x for r in v.df.collect()}


def _close(a, b, tol=1e-9):
    keys = set(a) | set(b)
    return all(abs(a.get(k, 0.0) - b.get(k, 0.0)) <= tol * max(1.0, abs(a.get(k, 0.0))) for k in keys)


@pytest.mark.parametrize("seed", [1, 2])
def test_layouts_agree(spark, seed):
    a = _random(spark, seed, 70, 50, 400)
    x = _rvec(spark, seed + 10, 50, 0.7)
    w = _rvec(spark, seed + 20, 70)
    ref = _as_dict(a.multiply(x, layout="join"))
    ref_t = _as_dict(a.multiply(w, trans=True, layout="join"))
    for layout in ("packed", "blocked"):
        assert _close(_as_dict(a.multiply(x, layout=layout, width=16)), ref), layout
        assert _close(_as_dict(a.multiply(w, trans=True, layout=layout, width=16)), ref_t), layout


@pytest.mark.parametrize("symmetry", ["symmetric", "skew-symmetric"])
def test_layouts_agree_on_triangle_storage(spark, symmetry):
    a = _random(spark, 3, 40, 40, 200, symmetry=symmetry)
    x = _rvec(spark, 4, 40)
    ref = _as_dict(a.multiply(x))
    for layout in LAYOUTS:
        assert _close(_as_dict(a.multiply(x, layout=layout, width=8)), ref), layout
    # triangle storage equals its expansion
    assert _close(_as_dict(a.expand().multiply(x)), ref)


def test_blocked_splits_hot_column_into_chunks(spark):
    """A column holding most entries is cut into several tiles, same numbers."""
    from tessera.operators import spmv

    triples = [(i, 0, 1.0 + i % 7) for i in range(3000)] + [(i, 1 + i % 9, 2.0) for i in range(300)]
    a = mat(spark, triples, 3000, 10)
    x = _rvec(spark, 5, 10)
    y = spmv.multiply_blocked(*spmv.tile_entries(a.entries, 4, 500), x.df, width=4)
    assert _close(_as_dict(VectorFrame(y, 3000, True)), _as_dict(a.multiply(x)))


def test_transpose_twice_and_adjoint(spark):
    a = _random(spark, 6, 30, 20, 150)
    tt = {(r.i, r.j, r.v) for r in a.transpose().transpose().entries.collect()}
    assert tt == {(r.i, r.j, r.v) for r in a.entries.collect()}
    assert a.transpose().shape == (20, 30)
    x, y = _rvec(spark, 7, 30), _rvec(spark, 8, 20)
    lhs = x.dot_value(a.multiply(y))
    rhs = a.multiply(x, trans=True).dot_value(y)
    assert abs(lhs - rhs) <= 1e-9 * max(1.0, abs(lhs))


def test_linearity(spark):
    a = _random(spark, 9, 25, 25, 120)
    x, y = _rvec(spark, 10, 25), _rvec(spark, 11, 25)
    lhs = _as_dict(a.multiply(x + y))
    rhs = _as_dict(a.multiply(x) + a.multiply(y))
    assert _close(lhs, rhs)
    assert _close(_as_dict(a.multiply(x.scale(3.0))), _as_dict(a.multiply(x).scale(3.0)))


def test_expand_of_lower_triangle_is_the_matrix(spark):
    s = _random(spark, 12, 30, 30, 150, dup=False, symmetry="symmetric")
    full = s.expand().canonicalize()
    back = mat(spark, [], 30, 30)
    back.entries = full.lower().entries
    back.symmetry = "symmetric"
    a = {(r.i, r.j): r.v for r in back.expand().canonicalize().entries.collect()}
    b = {(r.i, r.j): r.v for r in full.entries.collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_power_iteration_finds_dominant_direction(spark):
    from tessera.operators.power import power_iteration

    d = mat(spark, [(0, 0, 5.0), (1, 1, 2.0), (2, 2, 1.0), (1, 0, 0.1)], 3, 3, "symmetric")
    x0 = VectorFrame(spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "i long, x double"), 3, True)
    x, lam = power_iteration(d, x0, 30, checkpoint_every=10)
    v = _as_dict(x)
    assert abs(lam - 5.0) < 0.01
    assert abs(abs(v[0]) - 1.0) < 0.01


def test_repeat_multiply_reports_first_and_rest(spark):
    from tessera.operators.repeat import repeat_multiply

    a = _random(spark, 21, 30, 20, 100)
    out = repeat_multiply(a, _rvec(spark, 22, 20), runs=3, layout="packed")
    assert len(out["runs"]) == 3 and out["first"] > 0 and out["mean_rest"] > 0
