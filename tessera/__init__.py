"""tessera: distributed sparse matrix x vector algebra on Spark DataFrames.

A matrix is an entries DataFrame ``(i, j, v)`` (``MatrixFrame``), a vector is
``(i, x)`` (``VectorFrame``); products, structure operators, Matrix Market and
parquet reading and writing all run as Spark plans.
"""

from .matrix import LAYOUTS, MatrixFrame
from .vector import VectorFrame
from .operators.power import power_iteration, power_method
from .operators.repeat import repeat_multiply
from .sinks.matrix_market import (write_array, write_matrix_market, write_vector_pairs,
                                  write_vector_text)
from .sinks.parquet import write_matrix_parquet, write_vector_parquet
from .sources.matrix_market import (check_entries, read_entries, read_info, read_info_frame,
                                    read_matrix, read_vector, read_vectors)
from .sources.parquet import read_matrix_parquet, read_vector_parquet

__all__ = [
    "LAYOUTS", "MatrixFrame", "VectorFrame", "power_iteration", "power_method", "repeat_multiply",
    "read_matrix", "read_vector", "read_vectors", "read_entries", "read_info", "read_info_frame",
    "check_entries", "write_matrix_market", "write_array", "write_vector_text",
    "write_vector_pairs", "write_matrix_parquet", "write_vector_parquet",
    "read_matrix_parquet", "read_vector_parquet",
]
