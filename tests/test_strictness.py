"""No silent wrong or partial matrix: each case either reads right or fails."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import dense_values, mat, sparse_vec, vec
from tessera import MatrixFrame, VectorFrame
from tessera.operators.checks import check_results
from tessera.operators.power import power_iteration
from tessera.plans import physical_plan
from tessera.sinks.matrix_market import (write_array, write_complex_array, write_complex_matrix_market,
                                         write_matrix_market, write_vector_pairs, write_vector_text)
from tessera.sources.matrix_market import (check_entries, header_frame, names, read_all, read_entries, read_info,
                                            read_matrix, read_vector)

REAL = "%%MatrixMarket matrix coordinate real general\n"


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)
    return path


def cells(m):
    return sorted((r.i, r.j, r.v) for r in m.entries.collect())


# ------------------------------------------------------------------ reader
@pytest.mark.parametrize("quirk", ["\t\n", "\t% indented comment\n", " \t \n\n", "%\n" * 3000])
def test_blank_and_comment_lines_follow_one_rule(spark, tmpdir_path, quirk):
    p = write(tmpdir_path, "q.mtx", REAL + quirk + "3 3 2\n" + quirk + "1 1 1\n2 3 4\n")
    for strict in (True, False):
        m = read_matrix(spark, p, strict=strict)
        assert m.shape == (3, 3) and cells(m) == [(0, 0, 1.0), (1, 2, 4.0)]
    assert read_info(spark, p)[0].nnz == read_info(spark, p, full=True)[0].nnz == 2


def test_an_entry_equal_to_the_size_line_is_kept(spark, tmpdir_path):
    p = write(tmpdir_path, "s.mtx", REAL + "2 2 2\n2 2 2\n1 1 1\n")
    assert cells(read_matrix(spark, p)) == [(0, 0, 1.0), (1, 1, 2.0)]


@pytest.mark.parametrize("body, words", [("3 3 5\n1 1 1\n2 3 4\n", "declares 5 entries, the file holds 2"),
                                         ("2 2 1\n1 1 1\n2 2 2\n", "declares 1 entries, the file holds 2"),
                                         ("2 2 1\n", "declares 1 entries, the file holds 0"),
                                         ("2 2 1\n3 1 1\n", "outside the declared shape"),
                                         ("2 2 1\n0 1 1\n", "outside the declared shape")])
def test_wrong_counts_and_shapes_fail(spark, tmpdir_path, body, words):
    p = write(tmpdir_path, "w.mtx", REAL + body)
    with pytest.raises(Exception, match=words):
        read_matrix(spark, p).entries.collect()
    assert read_matrix(spark, p, strict=False).stored_count() == body.count("\n") - 1


def test_matrices_of_one_name_stay_apart(spark, tmpdir_path):
    write(tmpdir_path, "d1/m.mtx", REAL + "2 2 1\n2 2 1\n")
    write(tmpdir_path, "d2/m.mtx", REAL + "3 3 1\n3 3 1\n")
    entries, infos = read_entries(spark, f"{tmpdir_path}/d*/m.mtx")
    assert check_entries(entries, infos, spark).count() == 0
    assert {(r.key.split("/")[-2], r.i) for r in entries.collect()} == {("d1", 1), ("d2", 2)}
    write(tmpdir_path, "v/m.mtx_rd.txt", "1\n1\n")
    write(tmpdir_path, "r/m.mtx_rd.txt", "0\n1\n")
    with pytest.raises(ValueError, match="several matrices named"):
        check_results(spark, f"{tmpdir_path}/d*/m.mtx", f"{tmpdir_path}/v/*", f"{tmpdir_path}/r/*")


def test_recorded_results_of_own_files(spark, tmpdir_path):
    write(tmpdir_path, "m/a.mtx", REAL + "2 3 3\n1 1 2\n2 3 -1\n1 3 4\n")
    write(tmpdir_path, "m/b.mtx", REAL.replace("general", "symmetric") + "2 2 2\n1 1 1\n2 1 3\n")
    write(tmpdir_path, "m/unpaired.mtx", "not a matrix\n")
    write(tmpdir_path, "v/a.mtx_rd.txt", "1\n2\n3\n")
    write(tmpdir_path, "v/b.mtx_rd.txt", "1\n2\n")
    write(tmpdir_path, "r/a.mtx_rd.txt", "14\n-3\n")
    write(tmpdir_path, "r/b.mtx_rd.txt", "7\n4\n")
    got = {r.matrix_id: (r.max_abs, r.norm2) for r in check_results(
        spark, f"{tmpdir_path}/m/*.mtx", f"{tmpdir_path}/v/*", f"{tmpdir_path}/r/*").collect()}
    assert got == {"a.mtx": (0.0, 0.0), "b.mtx": (1.0, 1.0)}


def test_paths_with_blanks(spark, tmpdir_path):
    p = write(tmpdir_path, "x y/a b+c.mtx", REAL + "2 2 1\n2 1 5\n")
    assert cells(read_matrix(spark, p)) == [(1, 0, 5.0)]
    entries, infos = read_entries(spark, os.path.join(tmpdir_path, "x y", "*.mtx"))
    assert infos[0].matrix_id == entries.first().matrix_id == "a b+c.mtx"


def test_vectors_are_one_and_of_their_length(spark, tmpdir_path):
    p = write(tmpdir_path, "v/a.txt", "1\n2\n")
    write(tmpdir_path, "v/b.txt", "3\n")
    assert dense_values(read_vector(spark, p, 2)) == [1.0, 2.0]
    for path in (os.path.join(tmpdir_path, "v"), os.path.join(tmpdir_path, "v", "*.txt")):
        with pytest.raises(ValueError, match="one vector"):
            read_vector(spark, path)
    with pytest.raises(Exception, match="declared length 5 has 2 lines"):
        read_vector(spark, p, 5).df.collect()


def test_skew_arrays_of_both_conventions_and_refused_words(spark, tmpdir_path):
    head = "%%MatrixMarket matrix array real skew-symmetric\n3 3\n"
    for k, body in enumerate(("1\n2\n3\n", "0\n1\n2\n0\n3\n0\n")):
        m = read_matrix(spark, write(tmpdir_path, f"k{k}.mtx", head + body))
        assert dense_values(m.multiply(vec(spark, [1, 1, 1]))) == [-3.0, -2.0, 5.0]
    with pytest.raises(Exception, match="the file holds 4"):
        read_matrix(spark, write(tmpdir_path, "k4.mtx", head + "1\n2\n3\n4\n")).entries.collect()
    with pytest.raises(ValueError, match="pattern"):
        read_info(spark, write(tmpdir_path, "p.mtx", "%%MatrixMarket matrix array pattern general\n1 1\n1\n"))


def test_partitions_and_graph_of_a_file(spark, tmpdir_path):
    p = write(tmpdir_path, "g.mtx", REAL + "3 3 3\n1 2 1\n2 3 2\n3 1 3\n")
    assert read_matrix(spark, p, partitions=5).entries.rdd.getNumPartitions() == 5
    vertices, edges = read_matrix(spark, p).graph()
    assert {r.id for r in vertices.collect()} == {0, 1, 2}
    assert sorted((r.src, r.dst, r.attr) for r in edges.collect()) == [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 3.0)]
    with pytest.raises(ValueError, match="square"):
        mat(spark, [(0, 2, 1)], 2, 3).graph()


# ----------------------------------------------------------------- writers
def test_declared_kind_and_field_must_fit_the_values(spark, tmpdir_path):
    a = mat(spark, [(0, 1, 9), (1, 0, 2), (1, 1, 1.7)], 2, 2)
    for kind in ("symmetric", "skew-symmetric", "hermitian"):
        with pytest.raises(ValueError, match="declared"):
            write_matrix_market(a, os.path.join(tmpdir_path, kind), symmetry=kind)
        with pytest.raises(ValueError, match="declared"):
            write_array(a, os.path.join(tmpdir_path, "a" + kind), symmetry=kind)
    with pytest.raises(Exception, match="not a whole number"):
        write_matrix_market(a, os.path.join(tmpdir_path, "i"), field="integer")
    c = spark.createDataFrame([(0, 1, 1.0, 2.0), (1, 0, 5.0, 0.0)], "i long, j long, v double, im double")
    with pytest.raises(ValueError, match="imaginary"):
        write_complex_matrix_market(c, os.path.join(tmpdir_path, "c"), 2, 2, field="real")
    with pytest.raises(ValueError, match="declared"):
        write_complex_array(c, os.path.join(tmpdir_path, "d"), 2, 2, symmetry="hermitian")


def test_indices_outside_the_shape_are_refused(spark, tmpdir_path):
    v = VectorFrame(spark.createDataFrame([(0, 1.0), (7, 2.0)], "i long, x double"), 3)
    with pytest.raises(Exception, match="outside 0..2"):
        v.to_dense().df.collect()
    with pytest.raises(Exception, match="outside 0..2"):
        write_vector_text(v, os.path.join(tmpdir_path, "v"))
    a = mat(spark, [(0, 0, 1.0), (3, 1, 2.0)], 2, 2)
    for call in (lambda: a.to_dense().collect(), lambda: write_matrix_market(a, os.path.join(tmpdir_path, "m")),
                 lambda: write_array(a, os.path.join(tmpdir_path, "a"), symmetry="general")):
        with pytest.raises(Exception, match="outside 0..1"):
            call()
    with pytest.raises(ValueError, match="2\\*\\*63"):
        mat(spark, [(0, 0, 1.0)], 1 << 32, 1 << 31).to_dense()


# ------------------------------------------------------------------ layouts
@pytest.mark.parametrize("layout", ["join", "packed", "blocked", "graph"])
def test_a_null_value_fails_in_every_layout(spark, layout):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (1, 1, 3.0)], "i long, j long, v double")
    a = MatrixFrame.from_df(df, n_rows=2, n_cols=2)
    with pytest.raises(Exception, match="null matrix value"):
        a.multiply(vec(spark, [1, 1]), layout=layout).df.collect()


def test_row_matrix_keeps_segments_of_a_row_together(spark):
    a = mat(spark, [(0, 1, 1.0), (0, 5000, 2.0), (1, 3, 4.0)], 2, 10_000)
    rows = {}
    for r in a.row_matrix(width=4096).collect():
        rows.setdefault(r.row, []).extend(zip(r.idx, r.val))
    assert sorted(map(sorted, rows.values())) == [[(1, 1.0), (5000, 2.0)], [(3, 4.0)]]


def test_blocked_products_shuffle_entries_once_or_not_at_all(spark):
    a = mat(spark, [(i % 40, i % 30, float(i)) for i in range(500)], 40, 30)
    x = vec(spark, list(range(30)))
    want = dense_values(a.multiply(x))
    plan = physical_plan(a.multiply(x, layout="blocked", width=8).df)
    assert plan.count("hashpartitioning(i#") <= 3  # the cells, the result, and the operand's duplicates
    assert dense_values(a.multiply(x, layout="blocked", width=8)) == want
    a.prepare("blocked", width=8)
    ready = physical_plan(a.multiply(x, layout="blocked", width=8).df)
    assert "InMemoryTableScan" in ready and "hashpartitioning(i#" not in ready.split("InMemoryTableScan")[0]
    assert dense_values(a.multiply(x, layout="blocked", width=8)) == want
    a.unprepare("blocked", width=8)
    assert not a.is_prepared("blocked", width=8)


def test_symmetry_detection_joins_nothing(spark):
    for a, kind in [(mat(spark, [(0, 1, 2), (1, 0, 1), (1, 0, 1), (2, 2, 3)], 3, 3), "symmetric"),
                    (mat(spark, [(0, 1, 2), (1, 0, -2)], 3, 3), "skew-symmetric"),
                    (mat(spark, [(0, 1, 2), (1, 0, -2), (1, 1, 1)], 3, 3), "general"),
                    (mat(spark, [(0, 1, 2)], 3, 3), "general"), (mat(spark, [(0, 0, 2)], 1, 2), "general")]:
        found = a.symmetry_kind()
        assert found.first()["kind"] == kind
        assert "Join" not in physical_plan(found)


def test_power_iteration_frees_what_it_made_and_nothing_else(spark):
    a = mat(spark, [(0, 0, 2.0), (1, 1, 1.0), (0, 1, 1.0), (1, 0, 1.0)], 2, 2)
    x0 = vec(spark, [1, 1])
    a.prepare("packed")
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    x, norm = power_iteration(a, x0, 20)
    assert abs(norm - (3 + 5 ** 0.5) / 2) < 1e-6 and len(dense_values(x)) == 2
    assert a.is_prepared("packed") and len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    a.unprepare()


def test_indexed_entries_read_the_entries_once(spark):
    a = mat(spark, [(i % 7, (i * 11) % 97, 1.0) for i in range(300)], 7, 97)
    df = a.indexed_entries(width=16)
    rows = df.collect()
    plan = physical_plan(df).split("== Initial Plan ==")[0]
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan
    for i in range(7):
        mine = sorted((r.pos, r.j) for r in rows if r.i == i)
        assert [p for p, _ in mine] == list(range(len(mine))) and [j for _, j in mine] == sorted(j for _, j in mine)


def test_a_coordinate_matrix_is_scanned_once(spark, tmpdir_path):
    a = mat(spark, [(i % 50, i % 41, float(i)) for i in range(3000)], 50, 41)
    path = f"{tmpdir_path}/m.mtx"
    write_matrix_market(a, path, partitions=1)
    for strict in (True, False):
        got = read_matrix(spark, path, strict=strict)
        plan = physical_plan(got.entries, "simple")
        assert "Join" not in plan and "Window" not in plan
        if not strict:   # strict reads also count the lines, by a scalar subquery
            assert plan.count("FileScan text") == 1 and "Exchange" not in plan
        assert sorted(map(tuple, got.entries.collect())) == sorted(map(tuple, a.canonicalize().entries.where("v != 0").collect()))


def test_an_entry_that_looks_like_the_size_line_stays(spark, tmpdir_path):
    """The corner cell's value equals the number of entries, so its line repeats the size line, also at small splits."""
    path = f"{tmpdir_path}/corner.mtx"
    with open(path, "w") as f:
        f.write("%%MatrixMarket matrix coordinate integer general\n% a comment\n\n3 3 40\n")
        f.write("3 3 40\n" * 20 + "1 1 2\n" * 20)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128m", "100", "64"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = {tuple(r) for r in read_matrix(spark, path).canonicalize().entries.collect()}
            assert got == {(2, 2, 800.0), (0, 0, 40.0)}, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_folder_of_parts_is_scanned_once_and_counted(spark, tmpdir_path):
    import os

    folder = f"{tmpdir_path}/parts.mtx"
    os.makedirs(folder)
    for n, text in enumerate(("%%MatrixMarket matrix coordinate real general\n2 2 3\n1 1 1.5\n", "% none\n\n", "2 2 2.5\n1 2 3\n")):
        with open(f"{folder}/part-{n:05d}", "w") as f:
            f.write(text)
    assert sorted(map(tuple, read_matrix(spark, folder).entries.collect())) == [(0, 0, 1.5), (0, 1, 3.0), (1, 1, 2.5)]
    with open(f"{folder}/part-00003", "w") as f:
        f.write("2 1 9\n")
    with pytest.raises(Exception, match="declares 3 entries, the file holds 4"):
        read_matrix(spark, folder).entries.collect()
    assert read_matrix(spark, folder, strict=False).entries.count() == 4


def test_dense_outputs_are_placed_without_a_sample(spark, tmpdir_path):
    x = vec(spark, [float(k) for k in range(1000)])
    write_vector_text(x, f"{tmpdir_path}/x", partitions=7)
    lines = [r.value for r in spark.read.text(f"{tmpdir_path}/x").select("value", F.col("_metadata.file_path").alias("f"),
                                                                          F.monotonically_increasing_id().alias("m")).orderBy("f", "m").collect()]
    assert [float(t) for t in lines] == [float(k) for k in range(1000)]
    assert dense_values(read_vector(spark, f"{tmpdir_path}/x", 1000)) == [float(k) for k in range(1000)]
    a = mat(spark, [(i % 13, i % 7, float(i)) for i in range(60)], 13, 7)
    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    write_array(a, f"{tmpdir_path}/a.mtx", partitions=5)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == before
    back = read_matrix(spark, f"{tmpdir_path}/a.mtx")
    assert sorted(map(tuple, back.to_dense().collect())) == sorted(map(tuple, a.to_dense().collect()))


ALL_LAYOUTS = ["join", "packed", "blocked", "grid", "graph", "routed"]


@pytest.mark.parametrize("layout", ALL_LAYOUTS)
def test_a_null_index_fails_in_every_layout(spark, layout):
    for rows in ([(0, 0, 1.0), (None, 1, 2.0)], [(0, 0, 1.0), (1, None, 2.0)]):
        a = MatrixFrame.from_df(spark.createDataFrame(rows, "i long, j long, v double"), n_rows=2, n_cols=2)
        for trans in (False, True):
            with pytest.raises(Exception, match="index null|null matrix index"):
                a.multiply(vec(spark, [1, 1]), trans=trans, layout=layout).df.collect()


@pytest.mark.parametrize("layout", ALL_LAYOUTS)
def test_entries_outside_the_shape_fail_in_every_product(spark, layout):
    for bad in ((5, 0), (0, 7), (-1, 0), (0, -1)):
        a = mat(spark, [(0, 0, 1.0), (*bad, 2.0)], 2, 2)
        with pytest.raises(Exception, match="outside 0..1"):
            a.multiply(vec(spark, [1, 1]), layout=layout).df.collect()


def test_prepared_products_are_guarded_and_pairs_keep_their_length(spark, tmpdir_path):
    for balance in ("range", "nnz"):
        with pytest.raises(Exception, match="outside 0..1"):
            mat(spark, [(0, 0, 1.0), (0, 7, 2.0)], 2, 2).prepare(balance=balance)
    v = sparse_vec(spark, [(0, 1.0), (4, 2.0)], 2)
    with pytest.raises(Exception, match="outside 0..1"):
        write_vector_pairs(v, os.path.join(tmpdir_path, "pairs"))


def test_headers_and_results_of_many_files_stay_in_the_plan(spark, tmpdir_path, monkeypatch):
    for k in range(30):
        write(tmpdir_path, f"m/{k}.mtx", REAL + f"2 2 1\n1 2 {k}\n")
        write(tmpdir_path, f"v/{k}.mtx_rd.txt", "1\n2\n")
        write(tmpdir_path, f"r/{k}.mtx_rd.txt", "0\n0\n")
    write(tmpdir_path, "m/array.mtx", "%%MatrixMarket matrix array real skew-symmetric\n3 3\n1\n2\n3\n")
    kind, rows = type(spark.range(1)), []
    real = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: (lambda got: (rows.append(len(got)), got)[1])(real(self)))
    monkeypatch.setattr(kind, "inputFiles", None)
    heads = header_frame(spark, f"{tmpdir_path}/m/*.mtx")
    res = check_results(spark, f"{tmpdir_path}/m/*.mtx", f"{tmpdir_path}/v/*", f"{tmpdir_path}/r/*")
    assert sum(rows) == 0
    monkeypatch.undo()
    assert {r.matrix_id: r.max_abs for r in res.collect()} == {f"{k}.mtx": 2.0 * k for k in range(30)}
    got = {r.matrix_id: (r.representation, r.symmetry, r.n_rows, r.n_cols, r.nnz, r.data_lines, r.diagonal) for r in heads.collect()}
    assert got["array.mtx"] == ("array", "skew-symmetric", 3, 3, 3, 3, False) and got["7.mtx"] == ("coordinate", "general", 2, 2, 1, 1, True)


@pytest.mark.parametrize("text, words", [("no banner\n1 1 0\n", "not a %%MatrixMarket banner"), (REAL, "no size line"),
                                         ("%%MatrixMarket matrix coordinate real\n1 1 0\n", "banner needs 5 words"),
                                         (REAL + "2 x 1\n", "bad size line"), (REAL + "2 2\n", "bad size line"),
                                         ("%%MatrixMarket matrix array pattern general\n1 1\n1\n", "cannot have pattern")])
def test_wrong_headers_fail_the_job_that_reads_them(spark, tmpdir_path, text, words):
    write(tmpdir_path, "m/bad.mtx", text)
    write(tmpdir_path, "m/good.mtx", REAL + "1 1 1\n1 1 2\n")
    with pytest.raises(Exception, match=words):
        header_frame(spark, f"{tmpdir_path}/m/*").collect()
    entries, heads = read_all(spark, f"{tmpdir_path}/m/*", keys=names(spark, f"{tmpdir_path}/m/good*"))
    assert [(r.i, r.j, r.v, r.im, r.ok, r.inside) for r in entries.collect()] == [(0, 0, 2.0, None, True, True)]
    assert [r.matrix_id for r in heads.collect()] == ["good.mtx"]
