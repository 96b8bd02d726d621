"""Complex-valued matrices: entries ``(by..., i, j, v, im)`` (real and imaginary part).

Only Matrix Market ``complex`` files carry them. The operators mirror the real
ones: storage expansion (``hermitian`` mirrors the conjugate), the product with a
complex vector ``(i, x, xi)``, symmetry detection in the order symmetric,
skew-symmetric, hermitian, general, and real-vs-complex detection (no non-zero
imaginary part means ``real``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import hint_broadcast
from .structure import check_symmetry


def expand(entries: DataFrame, symmetry: str | Column, by: Sequence[str] = ()) -> DataFrame:
    """Full entries: symmetric ``A + A.' - D``, hermitian ``A + A' - D`` (conjugate
    mirror), skew-symmetric ``A - A.'`` (stored diagonal cancels). Narrow map."""
    if isinstance(symmetry, str):
        if check_symmetry(symmetry) == "general":
            return entries
        s = F.lit(symmetry)
    else:
        s = F.lower(symmetry)
    i, j, v, im = F.col("i"), F.col("j"), F.col("v"), F.col("im")

    def cell(a, b, re, ii):
        return F.struct(a.alias("i"), b.alias("j"), re.alias("v"), ii.alias("im"))

    same = cell(i, j, v, im)
    one = F.array(same)
    mirror = (F.when(s == "symmetric", F.array(same, cell(j, i, v, im)))
              .when(s == "hermitian", F.array(same, cell(j, i, v, -im)))
              .otherwise(F.array(same, cell(j, i, -v, -im))))
    arr = (F.when(s == "general", one)
           .when(i == j, F.when(s == "skew-symmetric", F.slice(one, 1, 0)).otherwise(one))
           .otherwise(mirror))
    return entries.select(*by, F.inline(arr))


def multiply(entries: DataFrame, vec: DataFrame, *, broadcast: bool | None = None,
             by: Sequence[str] = ()) -> DataFrame:
    """``y = A x`` for complex ``A`` and ``x`` (``xi`` column optional, 0 when absent);
    returns ``(by..., i, x, xi)``. Same plan as the real join layout."""
    xi = F.col("xi") if "xi" in vec.columns else F.lit(0.0)
    xs = vec.select(*by, F.col("i").alias("j"), F.col("x").alias("xr"), xi.alias("xim"))
    joined = entries.join(hint_broadcast(xs, broadcast), on=[*by, "j"], how="left")
    xr = F.coalesce(F.col("xr"), F.lit(0.0))
    xm = F.coalesce(F.col("xim"), F.lit(0.0))
    return joined.groupBy(*by, "i").agg(
        F.sum(F.col("v") * xr - F.col("im") * xm).alias("x"),
        F.sum(F.col("v") * xm + F.col("im") * xr).alias("xi"))


def canonicalize(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return entries.groupBy(*by, "i", "j").agg(F.sum("v").alias("v"), F.sum("im").alias("im"))


def symmetry_kind(entries: DataFrame, square: bool, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., kind)`` over full entries; hermitian is tested only when some
    imaginary part is non-zero, as for a real matrix it equals symmetric."""
    return describe(entries, square, by).drop("field")


def describe(entries: DataFrame, square: bool, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., kind, field)``: storage symmetry and real-vs-complex. A cell and its
    mirror meet in one keyed sum, the only shuffle of entries."""
    i, j = F.col("i"), F.col("j")

    def part(c: str, cond: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0.0)).alias(name)

    pairs = entries.groupBy(*by, F.least(i, j).alias("a"), F.greatest(i, j).alias("b")).agg(
        part("v", i > j, "low"), part("im", i > j, "low_im"), part("v", i < j, "up"), part("im", i < j, "up_im"),
        part("v", i == j, "diag"), part("im", i == j, "diag_im"))
    low, up, low_im, up_im = (F.col(c) for c in ("low", "up", "low_im", "up_im"))
    flags = pairs.groupBy(*by).agg(
        F.bool_and((low == up) & (low_im == up_im)).alias("sym"),
        F.bool_and((low == -up) & (low_im == -up_im) & (F.col("diag") == 0) & (F.col("diag_im") == 0)).alias("skew"),
        F.bool_and((low == up) & (low_im == -up_im) & (F.col("diag_im") == 0)).alias("herm"),
        F.max(F.greatest(F.abs(low_im), F.abs(up_im), F.abs("diag_im"))).alias("max_im"))
    t = F.lit(True)
    kind = (F.when(~F.lit(bool(square)), F.lit("general"))
            .when(F.coalesce(F.col("sym"), t), F.lit("symmetric"))
            .when(F.coalesce(F.col("skew"), t), F.lit("skew-symmetric"))
            .when(F.coalesce(F.col("max_im"), F.lit(0.0)) > 0,
                  F.when(F.coalesce(F.col("herm"), t), F.lit("hermitian")).otherwise(F.lit("general")))
            .otherwise(F.lit("general")))
    field = F.when(F.coalesce(F.col("max_im"), F.lit(0.0)) > 0, F.lit("complex")).otherwise(F.lit("real"))
    return flags.select(*by, kind.alias("kind"), field.alias("field"))


def value_field(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., field)``: ``complex`` if any imaginary part is non-zero, else ``real``."""
    return entries.groupBy(*by).agg(
        F.when(F.coalesce(F.max(F.abs("im")), F.lit(0.0)) > 0, F.lit("complex"))
        .otherwise(F.lit("real")).alias("field"))
