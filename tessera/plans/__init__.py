"""Physical-plan decisions the library makes itself, and plan inspection helpers.

Only one decision is ours: whether to put a ``broadcast`` hint on the operand
vector. It is taken from a *proven* row bound (a known length of a vector
whose indices are unique, or a counted row number), never from an estimate.
Above the bound the vector side gets a ``shuffle_hash`` hint instead, so the
entries are hashed and streamed, not sorted; AQE splits skewed partitions of
the entries side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# About 24 bytes per (long, double) row in a hashed relation: 4M rows ~ 100 MB
# per executor. Overridable per session with ``tessera.broadcast.maxRows``.
DEFAULT_MAX_BROADCAST_ROWS = 4_000_000


def max_broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get("tessera.broadcast.maxRows", str(DEFAULT_MAX_BROADCAST_ROWS)))


def may_broadcast(spark: SparkSession, row_bound: int | None) -> bool:
    return row_bound is not None and 0 <= row_bound <= max_broadcast_rows(spark)


def hint_broadcast(df: DataFrame, yes: bool | None) -> DataFrame:
    """Hint for the small (vector) side of a product join.

    ``True``: broadcast (its bound allows). ``False``: a shuffled hash join that
    builds on this side: the entries side is hashed and streamed, never sorted (a
    sort-merge join would sort every entry by column); each build partition holds
    about ``rows / shuffle partitions`` rows, and AQE still splits skewed partitions
    of the entries side (``ShuffledHashJoin(skew=true)``). ``None``: no hint, for
    sides of unknown size; Spark and AQE choose from (measured) sizes.
    """
    if yes is None:
        return df
    return F.broadcast(df) if yes else df.hint("shuffle_hash")


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints, as a string (for tests and benches)."""
    import contextlib
    import io

    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()
