"""Parquet storage: round trips keep metadata; row filters reach the scan."""

import os

from conftest import dense_values, mat, sparse_vec, vec
from tessera.plans import physical_plan
from tessera.sinks.parquet import write_matrix_parquet, write_vector_parquet
from tessera.sources.parquet import read_matrix_parquet, read_vector_parquet


def test_matrix_parquet_round_trip(spark, tmpdir_path):
    s = mat(spark, [(1, 0, 2), (2, 2, 5), (3, 1, -1)], 4, 4, "symmetric")
    path = os.path.join(tmpdir_path, "s")
    write_matrix_parquet(s, path, files=2)
    back = read_matrix_parquet(spark, path)
    assert (back.shape, back.symmetry) == ((4, 4), "symmetric")
    x = vec(spark, [1, 2, 3, 4])
    assert dense_values(back.multiply(x)) == dense_values(s.multiply(x))
    low = back.entries.where("i >= 3")
    plan = physical_plan(low)
    assert "PushedFilters: [IsNotNull(i), GreaterThanOrEqual(i,3)]" in plan
    assert {(r.i, r.j, r.v) for r in low.collect()} == {(3, 1, -1.0)}


def test_vector_parquet_round_trip(spark, tmpdir_path):
    v = sparse_vec(spark, [(0, 1.5), (7, -2.0)], 10)
    path = os.path.join(tmpdir_path, "v")
    write_vector_parquet(v.canonical(), path)
    back = read_vector_parquet(spark, path)
    assert back.length == 10 and back.unique
    assert dense_values(back) == [1.5, 0, 0, 0, 0, 0, 0, -2.0, 0, 0]
