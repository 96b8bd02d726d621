import math

import numpy as np
import pytest
from conftest import mat, sparse_vec, vec

from tessera import MatrixFrame
from tessera.operators.power import power_method


def ones(spark, n):
    return vec(spark, [1.0] * n)


@pytest.mark.parametrize("layout", ["join", "grid", "graph"])
def test_power_method_equals_numpy(spark, layout):
    rng = np.random.default_rng(3)
    full = rng.integers(0, 9, (30, 30)).astype(float)
    full = full + full.T
    low = [(i, j, full[i, j]) for i in range(30) for j in range(i + 1) if full[i, j]]
    a = MatrixFrame.from_entries(spark, low, 30, 30, "symmetric")
    r = power_method(a, ones(spark, 30), tolerance=1e-11, layout=layout)
    values, vectors = np.linalg.eigh(full)
    assert r.converged and r.residual <= 1e-11
    assert abs(r.eigenvalue - values[-1]) <= 1e-9 * values[-1]
    got = np.zeros(30)
    for row in r.vector.df.collect():
        got[row.i] = row.x
    assert np.allclose(np.abs(got), np.abs(vectors[:, -1]), atol=1e-8)
    assert not a.is_prepared(layout)


def test_negative_dominant_value_and_missing_rows(spark):
    a = mat(spark, [(0, 0, -5.0), (2, 2, 1.0)], 4, 4)
    r = power_method(a, ones(spark, 4), tolerance=1e-12)
    assert r.converged and abs(r.eigenvalue + 5.0) < 1e-11
    assert abs(r.vector.norm_value() - 1.0) < 1e-12


def test_residual_is_not_lost_to_cancellation(spark):
    a = mat(spark, [(0, 0, 1e8), (1, 1, 0.3e8)], 2, 2)
    r = power_method(a, ones(spark, 2), tolerance=1e-13, max_steps=60)
    x = {row.i: row.x for row in r.vector.df.collect()}
    true = math.sqrt(sum((c - r.eigenvalue) ** 2 * x.get(i, 0.0) ** 2 for i, c in ((0, 1e8), (1, 0.3e8)))) / 1e8
    assert r.converged and r.residual <= 1e-13 and true <= 2e-13


def test_no_convergence_and_defined_ends(spark):
    turn = mat(spark, [(0, 1, 1.0), (1, 0, -1.0)], 2, 2)
    r = power_method(turn, ones(spark, 2), max_steps=4)
    assert not r.converged and r.steps == 4
    zero = power_method(mat(spark, [(0, 1, 1.0)], 2, 2), vec(spark, [1.0, 0.0]))
    assert (zero.eigenvalue, zero.residual, zero.converged, zero.steps) == (0.0, 0.0, True, 1)
    with pytest.raises(ValueError, match="start vector"):
        power_method(turn, vec(spark, [0.0, 0.0]))
    with pytest.raises(ValueError, match="start vector"):
        power_method(turn, sparse_vec(spark, [], 2))
    with pytest.raises(ValueError, match="square"):
        power_method(mat(spark, [(0, 1, 1.0)], 2, 3), ones(spark, 3))
    with pytest.raises(ValueError, match="not finite"):
        power_method(mat(spark, [(0, 0, math.inf), (1, 1, 1.0)], 2, 2), ones(spark, 2))
    with pytest.raises(ValueError, match="length"):
        power_method(turn, ones(spark, 3))


def test_a_step_is_one_action(spark, monkeypatch):
    a = mat(spark, [(0, 0, 3.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 2.0)], 2, 2).prepare()
    runs, kind = [], type(a.entries)
    for name in ("first", "collect", "count", "checkpoint"):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, *k, _n=name, _f=real, **kw: (runs.append(_n), _f(self, *k, **kw))[1])
    r = power_method(a, ones(spark, 2), tolerance=1e-3)
    assert r.steps > 2
    assert runs == ["checkpoint"] * r.steps
    a.unprepare()
