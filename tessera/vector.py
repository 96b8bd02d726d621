"""``VectorFrame``: a long vector held as a DataFrame ``(i LONG, x)`` plus its length.

An absent index means 0. The vector is sparse by default (a product has one
row per non-empty matrix row) and densified only on request. Nothing is
collected: ``dot`` and ``norm`` return one-row DataFrames, with ``*_value``
helpers for the scalar.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hash_normal, in_range, keep_or_double

LengthLike = int | None | Callable[[], int]


class VectorFrame:
    def __init__(self, df: DataFrame, length: LengthLike = None, unique: bool = False):
        self.df = df
        self._length = length
        self.unique = unique          # at most one row per index
        self._rows: int | None = None

    # ------------------------------------------------------------ building
    @classmethod
    def from_df(cls, df: DataFrame, i: str = "i", x: str = "x", length: int | None = None,
                unique: bool = False) -> "VectorFrame":
        """Any DataFrame with an index and a value column. ``length=None``: max index
        + 1, computed when first needed. ``unique``: the caller guarantees one row per
        index (then the length bounds the rows, for the broadcast choice); otherwise
        repeated indices are allowed and summed where it matters."""
        xcol = keep_or_double(df, x)
        return cls(df.select(F.col(i).cast("long").alias("i"), xcol.alias("x")), length, unique)

    @classmethod
    def random_normal(cls, spark: SparkSession, length: int, seed: int = 0,
                      mean: float = 0.0, stddev: float = 1.0) -> "VectorFrame":
        """Dense random normal vector; each value depends on its index and the seed only."""
        df = spark.range(int(length)).select(
            F.col("id").alias("i"), hash_normal(F.col("id"), seed, mean, stddev).alias("x"))
        return cls(df, int(length), unique=True)

    # ------------------------------------------------------------ metadata
    @property
    def spark(self) -> SparkSession:
        return self.df.sparkSession

    @property
    def length(self) -> int:
        if callable(self._length):
            self._length = int(self._length())
        if self._length is None:
            row = self.df.agg(F.max("i").alias("m")).first()
            if row is None or row["m"] is None:
                raise ValueError("empty vector without a declared length")
            self._length = int(row["m"]) + 1
        return int(self._length)

    def known_length(self) -> int | None:
        return self._length if isinstance(self._length, int) else None

    def with_df(self, df: DataFrame) -> "VectorFrame":
        """The same vector metadata (length, uniqueness) over another DataFrame."""
        return VectorFrame(df, self._length, self.unique)

    def row_bound(self) -> int:
        """A proven upper bound on the number of rows (for the broadcast choice):
        the length when indices are unique, else the counted rows."""
        if self.unique and self._length is not None:
            return self.length
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def active_size(self) -> int:
        """Number of stored entries (zeros included), as the reference counts them."""
        return self.df.count()

    # ------------------------------------------------------------ reshaping
    def canonical(self) -> "VectorFrame":
        """Scatter-add: repeated indices summed (one keyed aggregation)."""
        if self.unique:
            return self
        return VectorFrame(self.df.groupBy("i").agg(F.sum("x").alias("x")), self._length, True)

    def to_dense(self) -> "VectorFrame":
        """All indices ``0 .. length-1``, absent ones as 0 (distributed range + left join).
        A stored index outside the length fails the job."""
        n = self.length
        zero = F.lit(0).cast(self.df.schema["x"].dataType)
        # checked on the values as well, which no plan prunes, so the check is evaluated
        stored = self.canonical().df.select(in_range(F.col("i"), n, F.col("i")).alias("i"),
                                            in_range(F.col("i"), n, F.col("x")).alias("x"))
        dense = (self.spark.range(n).withColumnRenamed("id", "i")
                 .join(stored, on="i", how="left")
                 .select("i", F.coalesce(F.col("x"), zero).alias("x")))
        return VectorFrame(dense, n, unique=True)

    # ------------------------------------------------------------ algebra
    def _check_same_length(self, other: "VectorFrame") -> None:
        if self.length != other.length:
            raise ValueError(f"vector lengths differ: {self.length} and {other.length}")

    def dot(self, other: "VectorFrame") -> DataFrame:
        """One row ``dot``: ``sum(x(i) y(i))`` over the indices both store."""
        self._check_same_length(other)
        a = self.canonical().df
        b = other.canonical().df.withColumnRenamed("x", "y")
        return a.join(b, on="i").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))

    def dot_value(self, other: "VectorFrame") -> float:
        v = self.dot(other).first()["dot"]
        return 0.0 if v is None else float(v)

    def __truediv__(self, a: float) -> "VectorFrame":
        if a == 0:
            raise ZeroDivisionError("cannot divide a vector by zero")
        return VectorFrame(self.df.select("i", (F.col("x") / F.lit(a)).alias("x")),
                           self._length, self.unique)

    def scale(self, a: float) -> "VectorFrame":
        return VectorFrame(self.df.select("i", (F.col("x") * F.lit(a)).alias("x")),
                           self._length, self.unique)

    def norm(self) -> DataFrame:
        """One row ``norm``: Euclidean norm of the (scatter-added) vector."""
        x = self.canonical().df
        return x.agg(F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("norm"))

    def norm_value(self) -> float:
        return float(self.norm().first()["norm"])

    def _combine(self, other: "VectorFrame", sign: float) -> "VectorFrame":
        self._check_same_length(other)
        b = other.df if sign > 0 else other.df.select("i", (-F.col("x")).alias("x"))
        both = self.df.unionByName(b)
        return VectorFrame(both.groupBy("i").agg(F.sum("x").alias("x")), self._length, True)

    def __add__(self, other: "VectorFrame") -> "VectorFrame":
        return self._combine(other, 1.0)

    def __sub__(self, other: "VectorFrame") -> "VectorFrame":
        return self._combine(other, -1.0)

    def multiply(self, other: "VectorFrame") -> "VectorFrame":
        """Element-wise product (indices stored in both)."""
        self._check_same_length(other)
        a = self.canonical().df
        b = other.canonical().df.withColumnRenamed("x", "y")
        return VectorFrame(a.join(b, on="i").select("i", (F.col("x") * F.col("y")).alias("x")),
                           self._length, True)

    def residual(self, expected: "VectorFrame") -> DataFrame:
        """One row: ``max_abs`` and ``norm2`` of ``self - expected``."""
        d = (self - expected).df
        return d.agg(F.coalesce(F.max(F.abs("x")), F.lit(0.0)).alias("max_abs"),
                     F.sqrt(F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0.0))).alias("norm2"))

    def checkpoint(self, eager: bool = True) -> "VectorFrame":
        """Cut the lineage by a reliable checkpoint in ``spark.checkpoint.dir``."""
        from .session import checkpoint_dir

        checkpoint_dir(self.spark)
        return self.with_df(self.df.checkpoint(eager))

    def __repr__(self) -> str:
        return f"VectorFrame(length={self._length!r}, unique={self.unique})"
