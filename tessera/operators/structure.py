"""Structural operators on an entries DataFrame ``(by..., i, j, v)``.

``by`` is an optional list of key columns (for example ``matrix_id``) so that one
plan handles many matrices at once; every operator keeps those columns.
Each operator is a narrow map or one keyed aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The symmetry words of the Matrix Market banner.
SYMMETRIES = ("general", "symmetric", "skew-symmetric", "hermitian")


def check_symmetry(word: str) -> str:
    w = word.lower()
    if w not in SYMMETRIES:
        raise ValueError(f"unknown symmetry {word!r}; expected one of {SYMMETRIES}")
    return w


def transpose(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``A'``: swap the two index columns (a projection, no data movement)."""
    return entries.select(*by, F.col("j").alias("i"), F.col("i").alias("j"), "v")


def expand(entries: DataFrame, symmetry: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Full entries from stored triangle entries.

    symmetric / hermitian (real values): ``A + A' - D``; skew-symmetric: ``A - A'``,
    so a stored diagonal cancels and is dropped. ``symmetry`` is a word, or a
    column when the frame holds many matrices of different kinds.
    A narrow map (``inline`` of a one- or two-element array): no shuffle.
    """
    if isinstance(symmetry, str):
        if check_symmetry(symmetry) == "general":
            return entries
        s = F.lit(symmetry)
    else:
        s = F.lower(symmetry)
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    same = F.struct(i.alias("i"), j.alias("j"), v.alias("v"))
    mirror = F.struct(j.alias("i"), i.alias("j"), v.alias("v"))
    negated = F.struct(j.alias("i"), i.alias("j"), (-v).alias("v"))
    one = F.array(same)
    arr = (
        F.when(s == "general", one)
        .when(s == "skew-symmetric",
              F.when(i == j, F.slice(one, 1, 0)).otherwise(F.array(same, negated)))
        .otherwise(F.when(i == j, one).otherwise(F.array(same, mirror)))
    )
    return entries.select(*by, F.inline(arr))


def canonicalize(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum duplicate ``(i, j)`` entries (partial aggregation before the shuffle)."""
    return entries.groupBy(*by, "i", "j").agg(F.sum("v").alias("v"))


def diagonal(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``A(i, i)`` as a vector ``(i, x)``; duplicates summed."""
    return (entries.where(F.col("i") == F.col("j"))
            .groupBy(*by, "i").agg(F.sum("v").alias("x")))


def lower_triangle(entries: DataFrame, strict: bool = False) -> DataFrame:
    cond = F.col("i") > F.col("j") if strict else F.col("i") >= F.col("j")
    return entries.where(cond)


def upper_triangle(entries: DataFrame, strict: bool = False) -> DataFrame:
    cond = F.col("i") < F.col("j") if strict else F.col("i") <= F.col("j")
    return entries.where(cond)


def shape_frame(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``max(i) + 1, max(j) + 1`` (as ``n_rows, n_cols``) and the stored count."""
    return entries.groupBy(*by).agg(
        (F.max("i") + 1).alias("n_rows"),
        (F.max("j") + 1).alias("n_cols"),
        F.count(F.lit(1)).alias("stored"),
    )


def nonzero_count(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Number of non-zero cells after duplicate summation (``nnz``)."""
    return (canonicalize(entries, by).where(F.col("v") != 0)
            .groupBy(*by).agg(F.count(F.lit(1)).alias("nnz")))


def symmetry_kind(entries: DataFrame, square: bool | DataFrame,
                  by: Sequence[str] = ()) -> DataFrame:
    """Detect symmetric / skew-symmetric / general over the full (expanded) entries.

    Order of the tests: non-square is general; else symmetric if every cell
    ``A(i,j)`` equals ``A(j,i)``; else skew-symmetric if it equals ``-A(j,i)``;
    else general (an absent cell is 0). A cell and its mirror meet in one keyed sum
    on ``(least, greatest)``, the only shuffle of entries, combined map-side.
    ``square`` is a flag for one matrix, or a frame ``(by..., n_rows, n_cols)`` when
    ``by`` keys many. Returns ``(by..., kind)``.
    """
    i, j, v = F.col("i"), F.col("j"), F.col("v")
    zero = F.lit(0).cast(entries.schema["v"].dataType)
    pairs = entries.groupBy(*by, F.least(i, j).alias("a"), F.greatest(i, j).alias("b")).agg(
        F.coalesce(F.sum(F.when(i > j, v)), zero).alias("low"),
        F.coalesce(F.sum(F.when(i < j, v)), zero).alias("up"),
        F.coalesce(F.sum(F.when(i == j, v)), zero).alias("diag"))
    flags = pairs.groupBy(*by).agg(
        F.bool_and(F.col("low") == F.col("up")).alias("is_sym"),
        F.bool_and((F.col("low") == -F.col("up")) & (F.col("diag") == 0)).alias("is_skew"),
    )
    if isinstance(square, DataFrame):
        flags = flags.join(square.select(*by, (F.col("n_rows") == F.col("n_cols")).alias("sq")),
                           on=list(by), how="right")
        sq = F.col("sq")
    else:
        sq = F.lit(bool(square))
    return flags.select(*by, classify(F.col("is_sym"), F.col("is_skew"), sq).alias("kind"))


def classify(is_sym: Column, is_skew: Column, square: Column) -> Column:
    return (F.when(~square, F.lit("general"))
            .when(F.coalesce(is_sym, F.lit(True)), F.lit("symmetric"))
            .when(F.coalesce(is_skew, F.lit(True)), F.lit("skew-symmetric"))
            .otherwise(F.lit("general")))
