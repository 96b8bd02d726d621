"""Complex Matrix Market files: hermitian storage, products, detection, writing."""

import os

from tessera.operators import complex as cx
from tessera.sinks.matrix_market import write_complex_matrix_market
from tessera.sources.matrix_market import read_entries

HERM = """%%MatrixMarket matrix coordinate complex hermitian
% full matrix: [[2, 1+1i, 0], [1-1i, 0, -2i], [0, 2i, 0]]
3 3 3
1 1 2.0 0.0
2 1 1.0 -1.0
3 2 0.0 2.0
"""


def _read(spark, path):
    entries, (info,) = read_entries(spark, path)
    return entries.where("ok").select("i", "j", "v", "im"), info


def _vec(spark, values):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(values)],
                                 "i long, x double, xi double")


def test_complex_hermitian_product(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "h.mtx")
    with open(p, "w") as fh:
        fh.write(HERM)
    e, info = _read(spark, p)
    assert (info.field, info.symmetry) == ("complex", "hermitian")
    full = cx.expand(e, info.symmetry)
    y = {r.i: (r.x, r.xi) for r in cx.multiply(full, _vec(spark, [(1, 0)] * 3)).collect()}
    assert y == {0: (3.0, 1.0), 1: (1.0, -3.0), 2: (0.0, 2.0)}
    y2 = {r.i: (r.x, r.xi) for r in cx.multiply(full, _vec(spark, [(0, 1), (0, 0), (0, 0)])).collect()}
    assert y2 == {0: (0.0, 2.0), 1: (1.0, 1.0), 2: (0.0, 0.0)}   # i * column 0
    assert cx.symmetry_kind(full, True).first()["kind"] == "hermitian"
    assert cx.value_field(full).first()["field"] == "complex"


def test_complex_kinds_and_real_detection(spark):
    rows = [(1, 0, 1.0, 2.0), (0, 1, 1.0, 2.0)]
    sym = spark.createDataFrame(rows, "i long, j long, v double, im double")
    assert cx.symmetry_kind(sym, True).first()["kind"] == "symmetric"
    skew = spark.createDataFrame([(1, 0, 1.0, 2.0), (0, 1, -1.0, -2.0)], "i long, j long, v double, im double")
    assert cx.symmetry_kind(skew, True).first()["kind"] == "skew-symmetric"
    real = spark.createDataFrame([(1, 0, 1.0, 0.0), (0, 1, 3.0, 0.0)], "i long, j long, v double, im double")
    assert cx.symmetry_kind(real, True).first()["kind"] == "general"
    assert cx.value_field(real).first()["field"] == "real"


def test_complex_write_read(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "h.mtx")
    with open(p, "w") as fh:
        fh.write(HERM)
    e, info = _read(spark, p)
    full = cx.expand(e, info.symmetry)
    out = os.path.join(tmpdir_path, "h_out.mtx")
    fld, sym, n = write_complex_matrix_market(full, out, 3, 3, partitions=2)
    assert (fld, sym, n) == ("complex", "hermitian", 3)
    e2, (info2,) = read_entries(spark, out, by_folder=True)
    got = {(r.i, r.j): (r.v, r.im) for r in e2.collect()}
    assert got == {(0, 0): (2.0, 0.0), (1, 0): (1.0, -1.0), (2, 1): (0.0, 2.0)}
    assert (info2.field, info2.symmetry) == ("complex", "hermitian")
