"""Named queries that write files to the shared scratch folder and read them back.

The folder is a fresh sub-folder of ``spark.checkpoint.dir`` (see
``tessera.session``); writing is part of the query, reading gives the result.
The returned DataFrame reads those files lazily, so they are left in place;
clearing the checkpoint folder between runs is the operator's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.checks import check_results as _check_results
from ..session import scratch_path
from ..operators import complex as cx
from ..sinks.matrix_market import (LINES_PER_FILE, write_array, write_complex_array, write_complex_matrix_market, write_lines,
                                   write_lines_many, write_matrix_market, write_vector_pairs, write_vector_text)
from ..sources.matrix_market import (check_entries, header_frame, read_entries, read_info, read_matrix, read_vector,
                                     valid_entries)
from ..sources.tables import DriverTables
from ..vector import VectorFrame
from .oracle import _HERM, N_NATIONS, N_ORDERS, N_PARTS, _with


def _r(df: DataFrame, digits: int, col: str) -> DataFrame:
    return df.withColumn(col, F.round(F.col(col).cast("double"), digits))


def mm_round_trip(spark, sf):
    t = DriverTables(spark, sf)
    path = scratch_path(spark, "li.mtx")
    write_matrix_market(t.li(), path)
    return read_matrix(spark, path, by_folder=True).entries


def mm_sym_round_trip(spark, sf):
    """Write SYM with symmetry detection (stores the lower triangle), read, expand."""
    t = DriverTables(spark, sf)
    path = scratch_path(spark, "sym.mtx")
    write_matrix_market(t.sym().expand().canonicalize(), path, symmetry=None)
    m = read_matrix(spark, path, by_folder=True)
    if m.symmetry != "symmetric":
        raise AssertionError(f"detected {m.symmetry}")
    return _r(m.expand().canonicalize().entries, 2, "v")


def mm_array_round_trip(spark, sf):
    t = DriverTables(spark, sf)
    path = scratch_path(spark, "nt_array.mtx")
    write_array(t.nt().canonicalize(), path)
    return _r(read_matrix(spark, path, by_folder=True).entries, 2, "v")


def mm_pattern_round_trip(spark, sf):
    t = DriverTables(spark, sf)
    path = scratch_path(spark, "li_pattern.mtx")
    write_matrix_market(t.li(), path, field="pattern")
    m = read_matrix(spark, path, by_folder=True)
    return m.entries


def mm_info(spark, sf):
    t = DriverTables(spark, sf)
    path = scratch_path(spark, "li_info.mtx")
    write_matrix_market(t.li(), path)
    (m,) = read_info(spark, path, by_folder=True)
    return spark.createDataFrame(
        [(m.representation, m.field, m.symmetry, m.n_rows, m.n_cols, m.nnz)],
        "representation string, field string, symmetry string, n_rows long, n_cols long, nnz long")


def mm_check(spark, sf):
    """A file with a fault of every kind: half the rows declared, every fifth entry
    malformed, one entry more declared than there are."""
    t = DriverTables(spark, sf)
    cells = t.li().canonicalize().entries.where(F.col("v") != 0)
    n = cells.count()
    text = F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1,
                       F.when(F.pmod("j", F.lit(5)) == 0, F.lit("?")).otherwise(F.col("v").cast("string")))
    path = scratch_path(spark, "li_faults.mtx")
    _write_text(cells, text, path, n, f"{t.n_orders // 2} {t.n_parts} {n + 1}")
    entries, infos = read_entries(spark, path, by_folder=True)
    return check_entries(entries, infos, spark).select("check", "n")


def _write_text(cells: DataFrame, text, path: str, rows: int, *head: str) -> None:
    """A coordinate file of hand-made lines: the banner, ``head``, then one per cell. Three part files,
    and more for many ``rows``, as a task sorts its file's lines."""
    spark = cells.sparkSession
    first = spark.createDataFrame([(0, k, 0, line) for k, line in enumerate(
        ("%%MatrixMarket matrix coordinate real general", *head))], "g int, a long, b long, value string")
    body = cells.select(F.lit(1).alias("g"), F.col("j").alias("a"), F.col("i").alias("b"), text.alias("value"))
    write_lines(first.unionByName(body), path, partitions=max(3, -(-rows // LINES_PER_FILE)))


def mm_quirks(spark, sf):
    """Tabs, blank lines of white space, indented comments before and between entries."""
    t = DriverTables(spark, sf)
    cells = t.nt().canonicalize().entries.where(F.col("v") != 0)
    n = cells.count()
    entry = F.concat(F.lit("  "), (F.col("i") + 1).cast("string"), F.lit("\t "), (F.col("j") + 1).cast("string"),
                     F.lit("   "), F.col("v").cast("string"), F.lit(" \t"))
    kinds = F.array(F.struct(F.lit(0).alias("k"), entry.alias("t")),
                    F.struct(F.lit(1).alias("k"), F.lit("\t % a comment between entries").alias("t")),
                    F.struct(F.lit(2).alias("k"), F.lit(" \t ").alias("t")))
    lines = cells.select("i", "j", F.explode(kinds).alias("e")).select(
        (F.col("i") * 3 + F.col("e.k")).alias("i"), "j", F.col("e.t").alias("t"))
    path = scratch_path(spark, "quirks.mtx")
    _write_text(lines, F.col("t"), path, 3 * n, "\t", "   % indented", f"\t{t.n_nations} {t.n_nations}\t{n}")
    return _r(read_matrix(spark, path, by_folder=True).entries, 2, "v")


def mm_graph(spark, sf):
    """A file read as a graph in one call: edges from row to column."""
    t = DriverTables(spark, sf)
    path = scratch_path(spark, "nt_graph.mtx")
    write_matrix_market(t.nt(), path)
    _, edges = read_matrix(spark, path, by_folder=True).graph()
    return _r(edges, 2, "attr")


def mm_skew_round_trip(spark, sf):
    t = DriverTables(spark, sf)
    path = scratch_path(spark, "skew.mtx")
    write_matrix_market(t.skew().expand().canonicalize(), path)
    m = read_matrix(spark, path, by_folder=True, partitions=3)
    if m.symmetry != "skew-symmetric":
        raise AssertionError(f"detected {m.symmetry}")
    return _r(m.expand().entries, 2, "v")


def mm_array_sym_round_trip(spark, sf):
    t = DriverTables(spark, sf)
    path = scratch_path(spark, "sym_array.mtx")
    kind = write_array(t.sym().expand().canonicalize(), path)
    m = read_matrix(spark, path, by_folder=True)
    if (kind, m.symmetry) != ("symmetric", "symmetric"):
        raise AssertionError(f"detected {kind}, read {m.symmetry}")
    return _r(m.expand().entries.where("v <> 0"), 2, "v")


def mm_array_skew_round_trip(spark, sf):
    """Both conventions of the triangle, with the zero diagonal and without."""
    t = DriverTables(spark, sf)
    out = None
    for diagonal in (True, False):
        path = scratch_path(spark, "skew_array.mtx")
        write_array(t.skew().expand().canonicalize(), path, skew_diagonal=diagonal)
        m = read_matrix(spark, path, by_folder=True)
        cells = _r(m.expand().entries.where("v <> 0"), 2, "v").select(F.lit(diagonal).alias("diagonal"), "i", "j", "v")
        out = cells if out is None else out.unionByName(cells)
    return out


def mm_complex_round_trip(spark, sf):
    """Hermitian values as a coordinate and as an array file, the kind detected."""
    t = DriverTables(spark, sf)
    full = cx.expand(t.hermitian_trade(), "hermitian")
    out = None
    for rep, write in (("coordinate", write_complex_matrix_market), ("array", write_complex_array)):
        path = scratch_path(spark, f"herm_{rep}.mtx")
        write(full, path, t.n_nations, t.n_nations)
        entries, (info,) = read_entries(spark, path, by_folder=True, strict_count=True)
        if (info.representation, info.symmetry) != (rep, "hermitian"):
            raise AssertionError(f"read {info}")
        cells = cx.expand(valid_entries(entries).drop("matrix_id"), info.symmetry).where("v <> 0 or im <> 0")
        cells = _r(_r(cells, 2, "v"), 2, "im").select(F.lit(rep).alias("representation"), "i", "j", "v", "im")
        out = cells if out is None else out.unionByName(cells)
    return out


def vector_round_trip(spark, sf):
    t = DriverTables(spark, sf)
    y = t.li().multiply(t.px())
    path = scratch_path(spark, "y.txt")
    write_vector_text(y, path)
    back = read_vector(spark, path, length=t.n_orders)
    return _r(back.df, 4, "x")


def vector_pairs_round_trip(spark, sf):
    t = DriverTables(spark, sf)
    y = t.li().multiply(t.ox(), trans=True)
    path = scratch_path(spark, "y_pairs")
    write_vector_pairs(y, path)
    back = spark.read.schema("i long, x double").csv(path)
    return _r(back, 4, "x")


def check_results(spark, sf):
    """Several matrices, vectors and recorded results paired by name, one plan."""
    t = DriverTables(spark, sf)
    base = scratch_path(spark, "check")
    write_matrix_market(t.li(), f"{base}/matrices/li.mtx")
    write_matrix_market(t.nt(), f"{base}/matrices/nt.mtx")
    write_vector_text(t.px(), f"{base}/vectors/li.mtx_rd.txt")
    write_vector_text(t.customers_per_nation(), f"{base}/vectors/nt.mtx_rd.txt")
    write_vector_text(t.ox(), f"{base}/output/li.mtx_rd.txt")
    write_vector_text(t.customers_per_nation(), f"{base}/output/nt.mtx_rd.txt")
    res = _check_results(spark, f"{base}/matrices/*/part-*", f"{base}/vectors/*/part-*",
                         f"{base}/output/*/part-*", by_folder=True)
    return _r(_r(res, 2, "max_abs"), 2, "norm2")


N_MANY = 200   # matrices written by the queries over many files


def _write_many(spark, t: DriverTables, path: str, words=None, value=None) -> None:
    """Lineitem cut into 200 matrices by order: line number x supplier, quantities summed."""
    words = F.lit("real") if words is None else words
    value = F.col("v").cast("string") if value is None else value
    li = t.table("lineitem").select((F.col("l_orderkey") % N_MANY).cast("long").alias("m"), F.col("l_linenumber").cast("long").alias("i"),
                                    F.col("l_suppkey").cast("long").alias("j"), F.col("l_quantity").cast("long").alias("v"))
    cells = li.groupBy("m", "i", "j").agg(F.sum("v").alias("v"))
    rows, cols = t._max_plus_one("lineitem", "l_linenumber"), t._max_plus_one("supplier", "s_suppkey")
    size = cells.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    head = size.select("m", F.explode(F.array(
        F.struct(F.lit(-2).cast("long").alias("at"), F.concat(F.lit("%%MatrixMarket matrix coordinate "), words, F.lit(" general")).alias("value")),
        F.struct(F.lit(-1).cast("long").alias("at"), F.concat_ws(" ", F.lit(rows), F.lit(cols), F.col("n")).alias("value")))).alias("l"))
    body = cells.select("m", (F.col("j") * F.lit(rows) + F.col("i")).alias("at"),
                        F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, value).alias("value"))
    write_lines_many(head.select("m", "l.*").unionByName(body).withColumnRenamed("m", "matrix_id"), path)


def mm_info_many(spark, sf):
    """The headers of 200 files of three fields as one table made inside the plan."""
    t = DriverTables(spark, sf)
    base = scratch_path(spark, "many")
    kind = F.col("m") % 3
    words = F.when(kind == 0, "real").when(kind == 1, "integer").otherwise("pattern")
    _write_many(spark, t, base, words, F.when(kind != 2, F.col("v").cast("string")))
    return header_frame(spark, f"{base}/*/part-*").drop("key", "diagonal")


def check_results_many(spark, sf):
    """200 matrices times the suppliers' balances against recorded results, paired by name."""
    t = DriverTables(spark, sf)
    base = scratch_path(spark, "check_many")
    _write_many(spark, t, f"{base}/matrices")
    every = F.explode(F.sequence(F.lit(0), F.lit(N_MANY - 1))).alias("matrix_id")
    n_supp, n_rows = t._max_plus_one("supplier", "s_suppkey"), t._max_plus_one("lineitem", "l_linenumber")
    bal = VectorFrame.from_df(t.table("supplier"), "s_suppkey", "s_acctbal", n_supp, unique=True).to_dense().df
    write_lines_many(bal.select(every, F.col("i").alias("at"), F.col("x").cast("string").alias("value")), f"{base}/vectors")
    # recorded: the matrix number plus the row
    write_lines_many(spark.range(n_rows).select(every, F.col("id").alias("at")).withColumn(
        "value", (F.col("matrix_id") + F.col("at")).cast("string")), f"{base}/output")
    res = _check_results(spark, *[f"{base}/{k}/*/part-*" for k in ("matrices", "vectors", "output")])
    return _r(_r(res, 2, "max_abs"), 2, "norm2")


def parquet_round_trip(spark, sf):
    from ..sinks.parquet import write_matrix_parquet
    from ..sources.parquet import read_matrix_parquet

    t = DriverTables(spark, sf)
    path = scratch_path(spark, "li_parquet")
    write_matrix_parquet(t.li(), path)
    return read_matrix_parquet(spark, path).entries


FILE_QUERIES = {
    "parquet_round_trip": parquet_round_trip,
    "mm_round_trip": mm_round_trip,
    "mm_sym_round_trip": mm_sym_round_trip,
    "mm_array_round_trip": mm_array_round_trip,
    "mm_pattern_round_trip": mm_pattern_round_trip,
    "mm_info": mm_info,
    "mm_check": mm_check,
    "mm_quirks": mm_quirks,
    "mm_graph": mm_graph,
    "mm_skew_round_trip": mm_skew_round_trip,
    "mm_array_sym_round_trip": mm_array_sym_round_trip,
    "mm_array_skew_round_trip": mm_array_skew_round_trip,
    "mm_complex_round_trip": mm_complex_round_trip,
    "vector_round_trip": vector_round_trip,
    "vector_pairs_round_trip": vector_pairs_round_trip,
    "check_results": check_results,
    "mm_info_many": mm_info_many,
    "check_results_many": check_results_many,
}

_MANY = (f"WITH cells AS (SELECT CAST(l_orderkey % {N_MANY} AS BIGINT) AS m, CAST(l_linenumber AS BIGINT) AS i, "
         "CAST(l_suppkey AS BIGINT) AS j, SUM(CAST(l_quantity AS BIGINT)) AS v FROM lineitem GROUP BY 1, 2, 3)")

FILE_ORACLE = {
    "parquet_round_trip": _with("li") + "SELECT i, j, v FROM li",
    "mm_round_trip": _with("canon") + "SELECT i, j, v FROM canon WHERE v <> 0",
    "mm_sym_round_trip": _with("symf") + "SELECT i, j, ROUND(SUM(v), 2) AS v FROM symf GROUP BY i, j "
                                         "HAVING SUM(v) <> 0",
    "mm_array_round_trip": _with("nt") + f", g AS (SELECT CAST(unnest(range(0, {N_NATIONS} * {N_NATIONS})) "
                           f"AS BIGINT) AS id), c AS (SELECT i, j, SUM(v) AS v FROM nt GROUP BY i, j) "
                           f"SELECT g.id % {N_NATIONS} AS i, g.id // {N_NATIONS} AS j, "
                           f"ROUND(COALESCE(c.v, 0), 2) AS v FROM g LEFT JOIN c "
                           f"ON c.i = g.id % {N_NATIONS} AND c.j = g.id // {N_NATIONS}",
    "mm_pattern_round_trip": _with("canon") + "SELECT i, j, CAST(1.0 AS DOUBLE) AS v FROM canon WHERE v <> 0",
    "mm_info": _with("canon") + f"SELECT 'coordinate' AS representation, 'real' AS field, "
                                f"'general' AS symmetry, {N_ORDERS} AS n_rows, {N_PARTS} AS n_cols, "
                                "count(*) AS nnz FROM canon WHERE v <> 0",
    "mm_check": _with("canon") + f", c AS (SELECT * FROM canon WHERE v <> 0) "
                                 f"SELECT 'out_of_shape' AS \"check\", count(*) AS n FROM c "
                                 f"WHERE i >= {N_ORDERS} // 2 AND j % 5 <> 0 HAVING count(*) > 0 UNION ALL "
                                 "SELECT 'malformed', count(*) FROM c WHERE j % 5 = 0 HAVING count(*) > 0 UNION ALL "
                                 "SELECT 'count', CAST(-1 AS BIGINT)",
    "mm_quirks": _with("nt") + "SELECT i, j, ROUND(SUM(v), 2) AS v FROM nt GROUP BY i, j HAVING SUM(v) <> 0",
    "mm_graph": _with("nt") + "SELECT i AS src, j AS dst, ROUND(SUM(v), 2) AS attr FROM nt GROUP BY i, j "
                              "HAVING SUM(v) <> 0",
    "mm_skew_round_trip": _with("skewf") + "SELECT i, j, ROUND(SUM(v), 2) AS v FROM skewf GROUP BY i, j "
                                           "HAVING SUM(v) <> 0",
    "mm_array_sym_round_trip": _with("symf") + "SELECT i, j, ROUND(SUM(v), 2) AS v FROM symf GROUP BY i, j "
                                               "HAVING SUM(v) <> 0",
    "mm_array_skew_round_trip": _with("skewf") + "SELECT d.diagonal, i, j, ROUND(SUM(v), 2) AS v FROM skewf, "
                                "(SELECT true AS diagonal UNION ALL SELECT false) d GROUP BY d.diagonal, i, j "
                                "HAVING SUM(v) <> 0",
    "mm_complex_round_trip": _HERM + "SELECT r.representation, i, j, ROUND(SUM(v), 2) AS v, ROUND(SUM(im), 2) AS im "
                             "FROM hf, (SELECT 'coordinate' AS representation UNION ALL SELECT 'array') r "
                             "GROUP BY r.representation, i, j HAVING SUM(v) <> 0 OR SUM(im) <> 0",
    "vector_round_trip": _with("li", "px") + f", r AS (SELECT CAST(unnest(range(0, {N_ORDERS})) AS BIGINT) AS i), "
                         "y AS (SELECT e.i AS i, SUM(e.v * COALESCE(x.x, 0)) AS x "
                         "FROM li e LEFT JOIN px x ON e.j = x.i GROUP BY e.i) "
                         "SELECT r.i AS i, ROUND(COALESCE(y.x, 0.0), 4) AS x FROM r LEFT JOIN y ON r.i = y.i",
    "vector_pairs_round_trip": _with("li", "ox") + "SELECT e.j AS i, ROUND(SUM(e.v * COALESCE(x.x, 0)), 4) AS x "
                               "FROM li e LEFT JOIN ox x ON e.i = x.i GROUP BY e.j",
    "check_results": _with("li", "px", "ox", "nt", "cpn")
    + ", y1 AS (SELECT e.i AS i, SUM(e.v * COALESCE(x.x, 0)) AS x FROM li e LEFT JOIN px x ON e.j = x.i "
      "GROUP BY e.i), r1 AS (SELECT i, COALESCE(x, 0) AS x FROM "
      f"(SELECT CAST(unnest(range(0, {N_ORDERS})) AS BIGINT) AS i) LEFT JOIN ox USING (i)), "
      "d1 AS (SELECT i, SUM(x) AS x FROM (SELECT i, x FROM y1 UNION ALL SELECT i, -x FROM r1) GROUP BY i), "
      "y2 AS (SELECT e.i AS i, SUM(e.v * COALESCE(x.x, 0)) AS x FROM nt e LEFT JOIN cpn x ON e.j = x.i "
      "GROUP BY e.i), r2 AS (SELECT i, COALESCE(x, 0) AS x FROM "
      f"(SELECT CAST(unnest(range(0, {N_NATIONS})) AS BIGINT) AS i) LEFT JOIN cpn USING (i)), "
      "d2 AS (SELECT i, SUM(x) AS x FROM (SELECT i, x FROM y2 UNION ALL SELECT i, -x FROM r2) GROUP BY i) "
      "SELECT 'li.mtx' AS matrix_id, ROUND(COALESCE(max(abs(x)), 0), 2) AS max_abs, "
      "ROUND(sqrt(COALESCE(SUM(x * x), 0)), 2) AS norm2 FROM d1 UNION ALL "
      "SELECT 'nt.mtx', ROUND(COALESCE(max(abs(x)), 0), 2), ROUND(sqrt(COALESCE(SUM(x * x), 0)), 2) FROM d2",
    "mm_info_many": _MANY + "SELECT 'matrix_id=' || m AS matrix_id, 'coordinate' AS representation, CASE m % 3 WHEN 0 THEN 'real' "
                    "WHEN 1 THEN 'integer' ELSE 'pattern' END AS field, 'general' AS symmetry, "
                    "(SELECT CAST(max(l_linenumber) + 1 AS BIGINT) FROM lineitem) AS n_rows, "
                    "(SELECT CAST(max(s_suppkey) + 1 AS BIGINT) FROM supplier) AS n_cols, count(*) AS nnz, "
                    "count(*) AS data_lines FROM cells GROUP BY m",
    "check_results_many": _MANY + ", y AS (SELECT m, i, SUM(v * COALESCE(s_acctbal, 0)) AS x FROM cells LEFT JOIN supplier "
                          "ON j = s_suppkey GROUP BY m, i), g AS (SELECT m, i FROM (SELECT DISTINCT m FROM cells), "
                          "(SELECT CAST(unnest(range(0, (SELECT max(l_linenumber) + 1 FROM lineitem))) AS BIGINT) AS i)), "
                          "d AS (SELECT g.m AS m, COALESCE(y.x, 0) - (g.m + g.i) AS x FROM g LEFT JOIN y ON g.m = y.m AND g.i = y.i) "
                          "SELECT 'matrix_id=' || m AS matrix_id, ROUND(max(abs(x)), 2) AS max_abs, "
                          "ROUND(sqrt(SUM(x * x)), 2) AS norm2 FROM d GROUP BY m",
}
