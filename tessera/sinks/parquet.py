"""Parquet storage of matrices and vectors (the fast format for repeated use).

Entries are range-partitioned on ``(i, j)`` and sorted inside each file, so every
file and row group covers a narrow row range (a hot row still spreads over
several files): filters on ``i`` (row blocks, triangles) prune row groups by
their min/max statistics, and a product's partial sums per task stay few.
The shape, symmetry and length are kept in a one-row ``_meta`` table next to
the data (read back by ``tessera.sources.parquet``).
"""

from __future__ import annotations

from pyspark import StorageLevel

from ..matrix import MatrixFrame
from ..session import default_parallelism
from ..vector import VectorFrame

ROWS_PER_FILE = 8_000_000   # about 100 MB of (long, long, double) parquet
META_SCHEMA = "kind string, n_rows long, n_cols long, symmetry string, is_unique boolean"


def _files(spark, rows: int) -> int:
    cores = default_parallelism(spark)
    return max(1, -(-rows // ROWS_PER_FILE), min(cores, rows // 100_000))


def _write_meta(spark, path: str, mode: str, row: tuple) -> None:
    spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.mode(mode).parquet(f"{path}/_meta")


def write_matrix_parquet(m: MatrixFrame, path: str, mode: str = "errorifexists",
                         files: int | None = None) -> None:
    """Stored entries (one triangle for symmetric kinds, duplicates kept) plus ``_meta``."""
    spark = m.spark
    # the count, the range sample and the write share one computation of the input
    entries = m.entries.select("i", "j", "v").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = files or _files(spark, entries.count())
        (entries.repartitionByRange(n, "i", "j").sortWithinPartitions("i", "j")
         .write.mode(mode).parquet(f"{path}/entries"))
    finally:
        entries.unpersist()
    _write_meta(spark, path, mode, ("matrix", m.n_rows, m.n_cols, m.symmetry, None))


def write_vector_parquet(x: VectorFrame, path: str, mode: str = "errorifexists",
                         files: int | None = None) -> None:
    """Stored entries of the vector (sparse, sorted by index) plus ``_meta``."""
    spark = x.spark
    n = files or _files(spark, x.row_bound())
    (x.df.select("i", "x").repartitionByRange(n, "i").sortWithinPartitions("i")
     .write.mode(mode).parquet(f"{path}/entries"))
    _write_meta(spark, path, mode, ("vector", x.length, None, None, x.unique))

