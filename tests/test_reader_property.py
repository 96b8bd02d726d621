"""Property test of the positional Matrix Market reader: whatever the comments,
blank lines, blanks and tabs, and however the file is split, every entry is read
once, the size line never becomes an entry, and array positions are exact."""

import os
import tempfile

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.sources.matrix_market import read_entries

SETTINGS = settings(max_examples=12, deadline=None, derandomize=True,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])


def _sep(draw):
    return draw(st.sampled_from([" ", "  ", "\t", " \t "]))


@st.composite
def coordinate_file(draw):
    n_rows = draw(st.integers(1, 40))
    n_cols = draw(st.integers(1, 40))
    cells = draw(st.lists(st.tuples(st.integers(0, n_rows - 1), st.integers(0, n_cols - 1),
                                    st.integers(-999, 999)), min_size=0, max_size=60))
    lines = ["%%MatrixMarket matrix coordinate real general"]
    lines += ["%" + "c" * draw(st.integers(0, 120)) for _ in range(draw(st.integers(0, 6)))]
    lines += [""] * draw(st.integers(0, 2))
    lines.append(f"{n_rows}{_sep(draw)}{n_cols}{_sep(draw)}{len(cells)}")
    for i, j, v in cells:
        if draw(st.booleans()):
            lines.append("")
        lead = draw(st.sampled_from(["", " ", "\t"]))
        lines.append(f"{lead}{i + 1}{_sep(draw)}{j + 1}{_sep(draw)}{v / 4}")
    return "\n".join(lines) + "\n", [(i, j, v / 4) for i, j, v in cells]


@st.composite
def array_file(draw):
    n_rows = draw(st.integers(1, 9))
    n_cols = draw(st.integers(1, 9))
    values = draw(st.lists(st.integers(-50, 50), min_size=n_rows * n_cols, max_size=n_rows * n_cols))
    lines = ["%%MatrixMarket matrix array real general", "% comment", f"{n_rows} {n_cols}"]
    for v in values:
        if draw(st.booleans()):
            lines.append("   ")
        lines.append(str(v))
    want = [(k % n_rows, k // n_rows, float(v)) for k, v in enumerate(values)]
    return "\n".join(lines) + "\n", want


def _read(spark, text, split):
    folder = tempfile.mkdtemp(prefix="tessera-prop-")
    path = os.path.join(folder, "m.mtx")
    with open(path, "w") as fh:
        fh.write(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        entries, _ = read_entries(spark, path)
        return sorted((r.i, r.j, r.v) for r in entries.where("ok").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@SETTINGS
@given(coordinate_file(), st.integers(16, 400))
def test_coordinate_positions(spark, case, split):
    text, want = case
    assert _read(spark, text, split) == sorted(want)


@SETTINGS
@given(array_file(), st.integers(8, 200))
def test_array_positions(spark, case, split):
    text, want = case
    assert _read(spark, text, split) == sorted(want)


@st.composite
def matrix_case(draw):
    n_rows = draw(st.integers(1, 30))
    n_cols = draw(st.integers(1, 30))
    vals = st.one_of(st.integers(-10**6, 10**6).map(float),
                     st.floats(allow_nan=False, allow_infinity=False, width=64))
    # unique cells: float sums of duplicates depend on the order partial sums arrive in
    cells = draw(st.dictionaries(st.tuples(st.integers(0, n_rows - 1), st.integers(0, n_cols - 1)),
                                 vals, max_size=50))
    cells = [(i, j, v) for (i, j), v in cells.items()]
    return n_rows, n_cols, cells, draw(st.integers(1, 6)), draw(st.integers(32, 600))


@SETTINGS
@given(matrix_case())
def test_write_read_identity(spark, case):
    from tessera import MatrixFrame
    from tessera.sinks.matrix_market import write_matrix_market
    from tessera.sources.matrix_market import read_matrix

    n_rows, n_cols, cells, parts, split = case
    df = spark.createDataFrame([(i, j, v) for i, j, v in cells] or [], "i long, j long, v double")
    m = MatrixFrame(df, n_rows, n_cols)
    want = {(i, j): v for i, j, v in cells if v != 0}
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-wr-"), "m.mtx")
    write_matrix_market(m, path, partitions=parts)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        back = read_matrix(spark, path, by_folder=True)
        got = {(r.i, r.j): r.v for r in back.entries.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert back.shape == (n_rows, n_cols)
    assert got == want
