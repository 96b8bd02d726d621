"""Column-level helpers: pure ``pyspark.sql.functions`` expressions (JVM side, codegen).

None of these is a Python UDF; they compose into whatever plan calls them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = float(2 ** 52)


def _as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_uniform(key: Column | str, seed: int) -> Column:
    """Uniform draw in (0, 1] that depends on ``key`` and ``seed`` only.

    ``rand(seed)`` depends on the partitioning of its input, so a recomputed
    partition (lost executor, other cluster size) would draw other numbers.
    """
    h = F.xxhash64(_as_col(key), F.lit(int(seed)))
    return (F.pmod(h, F.lit(2 ** 52).cast("long")).cast("double") + F.lit(1.0)) / F.lit(_TWO_52)


def hash_normal(key: Column | str, seed: int, mean: float = 0.0, stddev: float = 1.0) -> Column:
    """Normal draw by Box-Muller on two hash uniforms; deterministic per key and seed."""
    u1 = hash_uniform(key, seed)
    u2 = hash_uniform(key, seed + 1)
    g = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    return F.lit(float(mean)) + F.lit(float(stddev)) * g


def tokens(line: Column | str) -> Column:
    """Split a text line on runs of white space; no empty tokens."""
    return F.split(F.btrim(_as_col(line), F.lit(" \t\r\f\x0b")), r"\s+")


def to_long(c: Column) -> Column:
    return c.try_cast("bigint")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def number_text(c: Column | str, precision: int | None = None) -> Column:
    """Text of a number for Matrix Market output.

    ``precision=None`` gives Spark's exact round-trip text of the double;
    otherwise ``precision`` significant digits in exponent form, as ``%.{p-1}e``.
    """
    c = _as_col(c)
    if precision is None:
        return c.cast("double").cast("string")
    return F.format_string(f"%.{int(precision) - 1}e", c.cast("double"))


def block_of(index: Column | str, width: int) -> Column:
    """Block number of a 0-based index for blocks of ``width`` consecutive indices
    (integer ``div`` for a column name: exact for every 64-bit index)."""
    if isinstance(index, str):
        return F.expr(f"`{index}` div {int(width)}")
    return F.floor(index / F.lit(int(width))).cast("long")


def keep_or_double(df, name: str) -> Column:
    """Value column: DOUBLE and DECIMAL (the exact option) are kept, others cast to DOUBLE."""
    from pyspark.sql.types import DecimalType, DoubleType

    t = df.schema[name].dataType
    c = F.col(name)
    return c if isinstance(t, (DoubleType, DecimalType)) else c.cast("double")


def in_range(index: Column, size: int, value: Column) -> Column:
    """``value`` where ``0 <= index < size``; any other index fails the job."""
    fail = F.raise_error(F.concat(F.lit("index "), F.coalesce(index.cast("string"), F.lit("null")), F.lit(f" outside 0..{int(size) - 1}")))
    return F.when((index >= 0) & (index < F.lit(int(size))), value).otherwise(fail)


def not_null(value: Column, type_name: str, what: str) -> Column:
    """``value``; a null fails the job."""
    return F.coalesce(value, F.raise_error(F.lit(f"null {what}")).cast(type_name))
