"""Read matrices and vectors written by ``tessera.sinks.parquet``.

Only the one-row ``_meta`` table reaches the driver; the entries stay a lazy
parquet scan, so column pruning and filters on ``i`` / ``j`` reach the files.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..matrix import MatrixFrame
from ..vector import VectorFrame


def _meta(spark: SparkSession, path: str, kind: str):
    row = spark.read.parquet(f"{path}/_meta").first()
    if row is None or row["kind"] != kind:
        raise ValueError(f"{path}: not a stored {kind}")
    return row


def read_matrix_parquet(spark: SparkSession, path: str) -> MatrixFrame:
    meta = _meta(spark, path, "matrix")
    entries = spark.read.parquet(f"{path}/entries")
    return MatrixFrame(entries, meta["n_rows"], meta["n_cols"], meta["symmetry"])


def read_vector_parquet(spark: SparkSession, path: str) -> VectorFrame:
    meta = _meta(spark, path, "vector")
    entries = spark.read.parquet(f"{path}/entries")
    return VectorFrame(entries, meta["n_rows"], bool(meta["is_unique"]))
