"""Residual checks of products against recorded results, many matrices in one plan.

Matrices, operand vectors and expected results are paired **by name**
(``X.mtx`` with ``X.mtx<suffix>`` in the vector and result folders), never by
list position; every matrix is keyed by ``matrix_id`` through one plan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.matrix_market import hint_small, names, read_all, read_vectors, split_bound, valid_entries
from . import spmv, structure


def check_results(spark: SparkSession, matrices: str, vectors: str, results: str,
                  suffix: str = "_rd.txt", by_folder: bool | None = None) -> DataFrame:
    """``(matrix_id, max_abs, norm2)`` of ``A v - r`` for every matrix that has both a
    vector and a result. ``by_folder``: each matrix / vector is a folder of parts.

    Matrices, vectors and results are paired by joins on their names, and headers are
    parsed inside the plan: no name and no row per file reaches the driver. Files without a partner
    may hold anything. Two qualifying matrices of one name (in different folders) are
    refused, by a job over the names that returns one row at most; so are complex matrices, by
    the job that reads them."""
    # never null, so that no test for it is moved below the joins
    name = F.coalesce(F.regexp_replace(F.col("matrix_id"), re.escape(suffix) + "$", ""), F.lit("")).alias("matrix_id")
    wanted = names(spark, vectors, by_folder).select(name).intersect(names(spark, results, by_folder).select(name))
    found = names(spark, matrices, by_folder).join(wanted, "matrix_id")
    double = found.groupBy("matrix_id").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").first()
    if double is not None:
        raise ValueError(f"several matrices named {double['matrix_id']!r}: {double['a']}, {double['b']}, ...")
    entries, _ = read_all(spark, matrices, by_folder, keys=found, facts=("field", "symmetry"))
    fail = F.raise_error(F.concat(F.col("matrix_id"), F.lit(": complex values are not checked here")))
    stored = valid_entries(entries).select(
        "matrix_id", "i", "j", "v", F.when(F.col("field") == "complex", fail).otherwise(F.col("symmetry")).alias("symmetry"))
    full = structure.expand(stored, F.col("symmetry"), by=["matrix_id"])

    def keyed(path: str) -> DataFrame:
        of = names(spark, path, by_folder).select("key", name)
        ids = of.join(hint_small(spark, found.select("matrix_id"), split_bound(spark, matrices)), "matrix_id", "left_semi")
        return read_vectors(spark, path, by_folder=by_folder, ids=ids.withColumnRenamed("matrix_id", "vector_id")).withColumnRenamed(
            "vector_id", "matrix_id")

    x, r = keyed(vectors), keyed(results)
    y = spmv.multiply_join(full, x, by=["matrix_id"])
    d = (y.unionByName(r.select("matrix_id", "i", (-F.col("x")).alias("x")))
         .groupBy("matrix_id", "i").agg(F.sum("x").alias("x")))
    return d.groupBy("matrix_id").agg(
        F.coalesce(F.max(F.abs("x")), F.lit(0.0)).alias("max_abs"),
        F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("norm2"))
