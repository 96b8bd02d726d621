import math
import random

import numpy as np
import pytest

from tessera.llm import spectrum, whitening


def brute(rows, k=16):
    use = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows
           if v is not None and len(v) == 6 and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in use})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array([[(n * c - s) / n for c, s in zip(x, total)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    z = {i: (np.array([(n * c - s) / n for c, s in zip(x, total)]) @ vectors / np.sqrt(values),
             sum((n * c - s) ** 2 for c, s in zip(x, total))) for i, x in use}
    return n, values / np.trace(y.T @ y / n), z, [i for i, _ in use]


def corpus():
    rnd = random.Random(3)
    rows = [(k, [rnd.gauss(0, 1 + j) for j in range(6)]) for k in range(300)]
    rows += [(1000 + k, rows[k % 5][1]) for k in range(100)]
    rows += [(5000, None), (5001, []), (5002, [1.0] * 5), (5003, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (5004, [math.nan] * 6),
             (5005, [math.inf] + [1.0] * 5), (5006, [300.0, -300.0, 0.0, 0.0, 0.0, 0.0]), (5007, [0.0] * 6), (5008, [-0.001] * 6)]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_components_equal_numpy(spark, parts):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, component int, v string").repartition(parts)
    got = whitening.whitened_components(df).collect()
    n, explained, z, ids = brute(rows)
    assert len(got) == 6 * len(ids) and sorted({r["vec_id"] for r in got}) == sorted(ids)
    signs = {}
    for r in got:
        want, deviation = z[r["vec_id"]]
        k = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(explained[k], rel=1e-9)
        assert abs(r["whitened"]) == pytest.approx(abs(want[k]), abs=1e-8)
        if abs(want[k]) > 1e-3:
            signs.setdefault(k, set()).add(r["whitened"] * want[k] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (None, [1.0, 2.0])]):
        assert whitening.whitened_components(spark.createDataFrame(rows, schema)).collect() == []
    # two vectors span one component only
    got = whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [3.0, 2.0])], schema)).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["explained"]) for r in sorted(got, key=repr)] == [
        (1, 1, 2, 128 ** 2, 1.0), (2, 1, 2, 128 ** 2, 1.0), (None, 1, 2, 128 ** 2, 1.0)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in got)


def test_numbers_beyond_64_bits_fail(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        whitening.whitened_components(df).collect()


def test_packed_keys_are_one_per_vector():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(-s, s, (50, 4)) for s in (2, 130, 40000, 1 << 33)]) + whitening.SHIFT
    x[0], x[1] = np.array([-128, 127, 0, 0]) + whitening.SHIFT, np.array([-129, 128, 0, 0]) + whitening.SHIFT
    keys = whitening._packed(x)
    assert len(keys[0]) == 5 and len(keys[1]) == 9
    assert np.array_equal(whitening._unpacked(keys), x)
    assert len(set(keys)) == len({tuple(r) for r in x.tolist()})


def check_pairs(a, k):
    values, vectors = spectrum.leading_pairs(a, k)
    want = np.linalg.eigvalsh(a)[::-1][:k]
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - want).max() <= 1e-12 * scale
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-12 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(want))).max() <= 1e-12


def test_leading_pairs():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        x = rng.standard_normal((100, n))
        check_pairs(x.T @ x, 16)
    check_pairs(np.zeros((5, 5)), 3)
    check_pairs(np.eye(20), 16)
    check_pairs(np.ones((30, 30)), 16)
    x = rng.standard_normal((5, 64))
    check_pairs(x.T @ x, 16)
    q = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    a = (q * np.r_[5 - 1e-9 * np.arange(20), np.ones(44)]) @ q.T
    check_pairs((a + a.T) / 2, 16)
    wilkinson = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    check_pairs(wilkinson, 21)


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    e[[4, 11]] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    shifts = np.r_[-10, (values[:-1] + values[1:]) / 2, 10]
    assert spectrum.count_below(d, e, shifts).tolist() == list(range(31))
