"""Distributed writers: Matrix Market files and vector text.

Header lines and entries get one order key. Dense outputs know every line's place, and so its
part file (``write_placed``); coordinate entries are cut by ``repartitionByRange`` (Spark
samples the key to cut ranges; all rows are kept). With ``sortWithinPartitions`` the part
files of the output folder, read in name order, are one valid file: banner and size
line land in the first part. No row goes through the driver;
only the entry count (for the size line) is computed there as a scalar.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import in_range, number_text
from ..matrix import MatrixFrame
from ..operators import structure as st
from ..session import default_parallelism
from ..vector import VectorFrame


LINES_PER_FILE = 4_000_000   # about 100 MB of text per part file
MIN_LINES_PER_FILE = 50_000  # small outputs: no more files than this allows




def _file_count(spark: SparkSession, partitions: int | None, rows: int | None) -> int:
    """Part files for so many lines: at most ``LINES_PER_FILE`` each (about 100 MB), and for
    small outputs up to one per core as long as each keeps ``MIN_LINES_PER_FILE`` lines, so
    that reading it back is parallel too (not the cluster's shuffle setting)."""
    if partitions:
        return int(partitions)
    if rows is not None:
        rows = int(rows)
        return max(1, -(-rows // LINES_PER_FILE), min(default_parallelism(spark), rows // MIN_LINES_PER_FILE))
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_lines(lines: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists",
                rows: int | None = None) -> None:
    """``lines(g, a, b, value)``: write ``value`` ordered by ``(g, a, b)``; ranges are sampled."""
    n = _file_count(lines.sparkSession, partitions, rows)
    order = ["g", "a", "b"]
    (lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
     .select("value").write.mode(mode).text(path))


def write_placed(lines: DataFrame, path: str, places: int, partitions: int | None = None, mode: str = "errorifexists",
                 rows: int | None = None) -> None:
    """``lines(at, value)``: write ``value`` in the order of ``at`` in ``0 .. places-1`` (header lines: below 0).

    Places are known, so a line's part file follows from its place alone: lines are sent
    there directly, nothing is sampled, and the lines are computed once."""
    n = _file_count(lines.sparkSession, partitions, rows)
    width = max(1, -(-int(places) // n))
    part = F.greatest(F.lit(0), F.expr(f"at div {width}")).cast("int")
    (lines.withColumn("part", part).repartitionById(n, "part").sortWithinPartitions("at")
     .select("value").write.mode(mode).text(path))


def detect_symmetry(m: MatrixFrame) -> str:
    """The storage kind of the values; a matrix that is not square is general."""
    if m.n_rows != m.n_cols:
        return "general"
    row = m.symmetry_kind().first()
    return row["kind"] if row else "general"


def _storage_kind(m: MatrixFrame, symmetry: str | None) -> str:
    """The kind to write: detected (``None``), or the declared one if the values allow it,
    so that no entry of the other triangle is lost."""
    if symmetry is None:
        return detect_symmetry(m)
    kind = st.check_symmetry(symmetry)
    if kind == "hermitian":   # real values: the same as symmetric
        kind = "symmetric"
    if kind == "general" or m.symmetry == kind:
        return st.check_symmetry(symmetry)
    found = detect_symmetry(m)
    if found != kind and not (m.n_rows == m.n_cols and m.nnz() == 0):
        raise ValueError(f"declared {symmetry}, but the values are {found}")
    return st.check_symmetry(symmetry)


def _triangle(cells: DataFrame, kind: str, skew_diagonal: bool = False) -> DataFrame:
    if kind == "general":
        return cells
    strict = kind == "skew-symmetric" and not skew_diagonal
    return cells.where(F.col("i") > F.col("j") if strict else F.col("i") >= F.col("j"))


def _whole(v, what: str):
    """The value as a whole number; any other value fails the job."""
    return F.when(v == v.cast("long"), v.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit(what + " is not a whole number: "), v.cast("string"))))


def write_matrix_market(m: MatrixFrame, path: str, *, field: str = "real",
                        symmetry: str | None = None, comments: tuple[str, ...] = (),
                        precision: int | None = None, n_rows: int | None = None,
                        n_cols: int | None = None, partitions: int | None = None,
                        mode: str = "errorifexists", date_stamp: bool = False) -> int:
    """Write the non-zero cells of ``m`` as a ``coordinate`` file; returns the entry count.

    ``date_stamp`` adds a comment line with today's date when no comment is given
    (off by default, so that the output is deterministic).

    ``symmetry=None`` detects it (symmetric, skew-symmetric or general, in that
    order); a triangle kind stores the lower triangle, and a declared kind that the
    values contradict is refused. ``field`` is ``real``, ``integer`` (a value that is
    not whole fails the job) or ``pattern``; ``precision`` = significant digits (None:
    exact round-trip text). Duplicates are summed; entries are in column-major order.
    An entry outside the shape fails the job, unless ``n_rows`` / ``n_cols`` override
    the declared shape (the checker then reports such entries).
    """
    if field not in ("real", "integer", "pattern"):
        raise ValueError(f"unsupported field {field!r}")
    sym = _storage_kind(m, symmetry)
    own_shape = n_rows is None and n_cols is None
    cells = m.checked_cells() if own_shape else st.canonicalize(m.full_entries())
    cells = _triangle(cells.where(F.col("v") != 0), sym)
    # the count (size line), the range sample and the write share one computation
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    count = cells.count()
    r = n_rows if n_rows is not None else m.n_rows
    c = n_cols if n_cols is not None else m.n_cols
    header = [f"%%MatrixMarket matrix coordinate {field} {sym}"]
    if date_stamp and not comments:
        import datetime

        comments = (datetime.date.today().strftime("%d-%b-%Y"),)
    header += ["%" + (t if t.startswith(" ") or not t else " " + t) for t in comments]
    header.append(f"{r} {c} {count}")
    spark = m.spark
    head = spark.createDataFrame([(0, k, 0, line) for k, line in enumerate(header)],
                                 "g int, a long, b long, value string")
    i1 = (F.col("i") + 1).cast("string")
    j1 = (F.col("j") + 1).cast("string")
    if field == "pattern":
        text = F.concat_ws(" ", i1, j1)
    elif field == "integer":
        text = F.concat_ws(" ", i1, j1, _whole(F.col("v"), "integer field: value").cast("string"))
    else:
        text = F.concat_ws(" ", i1, j1, number_text(F.col("v"), precision))
    body = cells.select(F.lit(1).alias("g"), F.col("j").alias("a"), F.col("i").alias("b"),
                        text.alias("value"))
    try:
        write_lines(head.unionByName(body), path, partitions, mode, rows=count + len(header))
    finally:
        cells.unpersist()
    return count


def write_lines_many(lines: DataFrame, path: str, partitions: int | None = None, mode: str = "errorifexists") -> None:
    """``lines(matrix_id, at, value)``: one folder ``matrix_id=...`` per matrix under ``path``, its lines
    ordered by ``at``; all of them in one job. A matrix is written by one task, as one file: for
    many small matrices (a large one is written by the other writers)."""
    n = partitions or int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (lines.select("matrix_id", "at", "value").repartition(n, "matrix_id").sortWithinPartitions("matrix_id", "at")
     .select("matrix_id", "value").write.mode(mode).partitionBy("matrix_id").text(path))


def write_array(m: MatrixFrame, path: str, *, symmetry: str | None = None, skew_diagonal: bool = True,
                precision: int | None = None, partitions: int | None = None,
                mode: str = "errorifexists") -> str:
    """Dense ``array real`` file, column-major; returns the storage kind.

    ``symmetry=None`` detects it; a declared kind that the values contradict is refused.
    A triangle kind writes each column from the diagonal down; for ``skew-symmetric``
    that includes the zero diagonal, or not with ``skew_diagonal=False`` (the reader
    takes both). Only for shapes whose cell count is meant to be written."""
    kind = _storage_kind(m, symmetry)
    if kind == "hermitian":
        raise ValueError("hermitian array output needs complex values; use write_complex_array")
    dense = _triangle(m.to_dense(), kind, skew_diagonal)
    _write_dense(dense.select("i", "j", number_text(F.col("v"), precision).alias("value")), path,
                 f"array real {kind}", m.n_rows, m.n_cols, partitions, mode)
    return kind


def _write_dense(cells: DataFrame, path: str, words: str, n_rows: int, n_cols: int, partitions: int | None,
                 mode: str) -> None:
    head = cells.sparkSession.createDataFrame(
        [(-2, f"%%MatrixMarket matrix {words}"), (-1, f"{n_rows} {n_cols}")], "at long, value string")
    body = cells.select((F.col("j") * F.lit(n_rows) + F.col("i")).alias("at"), "value")
    write_placed(head.unionByName(body), path, n_rows * n_cols, partitions, mode, rows=n_rows * n_cols)


def write_complex_array(entries: DataFrame, path: str, n_rows: int, n_cols: int, *, symmetry: str | None = None,
                        skew_diagonal: bool = True, precision: int | None = None, partitions: int | None = None,
                        mode: str = "errorifexists") -> str:
    """Dense ``array complex`` file of full entries ``(i, j, v, im)``; returns the kind.
    Kinds as in ``write_array``, and ``hermitian``."""
    from ..operators import complex as cx

    kind = _complex_kind(entries, n_rows, n_cols, symmetry)
    if n_rows * n_cols >= 1 << 63:
        raise ValueError(f"a dense {n_rows} x {n_cols} matrix has more than 2**63 cells")
    cells = _checked_complex(cx.canonicalize(entries), n_rows, n_cols)
    grid = entries.sparkSession.range(n_rows * n_cols).select(
        F.expr(f"id div {n_cols}").alias("i"), F.expr(f"id % {n_cols}").alias("j"))
    dense = grid.join(cells, on=["i", "j"], how="left").fillna(0.0, ["v", "im"])
    text = F.concat_ws(" ", number_text(F.col("v"), precision), number_text(F.col("im"), precision))
    _write_dense(_triangle(dense, kind, skew_diagonal).select("i", "j", text.alias("value")), path,
                 f"array complex {kind}", n_rows, n_cols, partitions, mode)
    return kind


def _complex_kind(entries: DataFrame, n_rows: int, n_cols: int, symmetry: str | None) -> str:
    from ..operators import complex as cx

    if symmetry is not None and st.check_symmetry(symmetry) == "general":
        return "general"
    row = cx.describe(entries, n_rows == n_cols).first()
    found = row["kind"] if row else "general"
    if symmetry is None or symmetry == found:
        return found
    if symmetry == "hermitian" and found == "symmetric" and row["field"] == "real":
        return symmetry
    raise ValueError(f"declared {symmetry}, but the values are {found}")


def _checked_complex(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    i, j = F.col("i"), F.col("j")
    return cells.select("i", "j", in_range(i, n_rows, in_range(j, n_cols, F.col("v"))).alias("v"), "im")


def write_vector_text(x: VectorFrame, path: str, *, precision: int | None = None,
                      partitions: int | None = None, mode: str = "errorifexists") -> None:
    """Dense vector, one number per line in index order (absent indices written as 0)."""
    lines = x.to_dense().df.select(F.col("i").alias("at"), number_text(F.col("x"), precision).alias("value"))
    write_placed(lines, path, x.length, partitions, mode, rows=x.length)


def write_vector_pairs(x: VectorFrame, path: str, mode: str = "errorifexists") -> None:
    """Stored entries as ``i,x`` CSV part files (no order, no densifying). An index outside the
    length fails the job."""
    x.df.select(in_range(F.col("i"), x.length, F.col("i")).alias("i"), "x").write.mode(mode).csv(path)


def write_complex_matrix_market(entries: DataFrame, path: str, n_rows: int, n_cols: int, *,
                                symmetry: str | None = None, field: str | None = None,
                                precision: int | None = None, partitions: int | None = None,
                                mode: str = "errorifexists") -> tuple[str, str, int]:
    """Write full complex entries ``(i, j, v, im)``. ``field=None`` detects real vs
    complex (no non-zero imaginary part: ``real``); ``field="real"`` is refused for
    complex values. ``symmetry=None`` detects symmetric, skew-symmetric, hermitian or
    general; a declared kind that the values contradict is refused. Returns ``(field, symmetry, count)``."""
    from ..operators import complex as cx

    found = cx.value_field(entries).first()["field"]
    if field == "real" and found == "complex":
        raise ValueError("field real, but the values have imaginary parts")
    fld = field or found
    sym = _complex_kind(entries, n_rows, n_cols, symmetry)
    cells = _checked_complex(cx.canonicalize(entries), n_rows, n_cols)
    cells = _triangle(cells.where((F.col("v") != 0) | (F.col("im") != 0)), sym)
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    count = cells.count()
    header = [f"%%MatrixMarket matrix coordinate {fld} {sym}", f"{n_rows} {n_cols} {count}"]
    head = entries.sparkSession.createDataFrame(
        [(0, k, 0, line) for k, line in enumerate(header)], "g int, a long, b long, value string")
    parts = [(F.col("i") + 1).cast("string"), (F.col("j") + 1).cast("string"),
             number_text(F.col("v"), precision)]
    if fld == "complex":
        parts.append(number_text(F.col("im"), precision))
    body = cells.select(F.lit(1).alias("g"), F.col("j").alias("a"), F.col("i").alias("b"),
                        F.concat_ws(" ", *parts).alias("value"))
    try:
        write_lines(head.unionByName(body), path, partitions, mode, rows=count + len(header))
    finally:
        cells.unpersist()
    return fld, sym, count
