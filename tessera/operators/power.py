"""Power iteration (dominant eigenvector), named in the reference's notes: a fixed number
of steps (``power_iteration``), or steps until the residual is small (``power_method``).

Each step of ``power_iteration`` is one distributed product and one norm (a scalar to the driver).
The product of a step is persisted (memory and disk) and materialized by the
norm, so the next step reads it instead of recomputing the chain; the
previous step's copy is then dropped, and the last one too: the result is written
to the checkpoint folder, so nothing stays cached that the caller did not cache. Every ``checkpoint_every`` steps the
vector is also written to the shared checkpoint folder
(``spark.checkpoint.dir``), which cuts the lineage that a lost executor
would otherwise replay.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..matrix import MatrixFrame
from ..session import checkpoint_dir
from ..vector import VectorFrame


def power_iteration(a: MatrixFrame, x0: VectorFrame, steps: int, layout: str = "join",
                    checkpoint_every: int | None = 5,
                    prepare: bool = True) -> tuple[VectorFrame, float]:
    """``steps`` rounds of ``x <- A x / ||A x||``; returns the vector and the last norm.

    ``prepare``: the matrix is read once into its layout form (cached, clustered
    by row, see ``MatrixFrame.prepare``) for all steps, and released at the end,
    unless the caller prepared it already."""
    if a.n_rows != a.n_cols:
        raise ValueError(f"power iteration needs a square matrix, got {a.shape}")
    owns = prepare and steps > 1 and not a.is_prepared(layout)
    if owns:
        a.prepare(layout)
    try:
        return _iterate(a, x0, steps, layout, checkpoint_every)
    finally:
        if owns:
            a.unprepare(layout)


def _iterate(a: MatrixFrame, x0: VectorFrame, steps: int, layout: str,
             checkpoint_every: int | None) -> tuple[VectorFrame, float]:
    x, norm = x0, 0.0
    held = None
    for k in range(1, steps + 1):
        y = a.multiply(x, layout=layout, check=(k == 1))
        if checkpoint_every and k % checkpoint_every == 0:
            y = y.checkpoint()
        else:
            y = y.with_df(y.df.persist(StorageLevel.MEMORY_AND_DISK))
        norm = y.norm_value()          # materializes y
        if held is not None:
            held.unpersist()
        held = y.df
        if norm == 0.0:
            break
        x = y / norm
    out = x if norm or held is None else y
    if held is not None:
        out = out.checkpoint()
        held.unpersist()
    return out, norm


@dataclass(frozen=True)
class Dominant:
    """Where the power method ended: ``vector`` has norm 1; ``residual`` is
    ``||A x - eigenvalue x|| / |eigenvalue|`` of that vector (0 for an eigenvalue 0)."""
    eigenvalue: float
    vector: VectorFrame
    steps: int
    residual: float
    converged: bool


def _step(a: MatrixFrame, x: DataFrame, length: int, layout: str, shift: float) -> tuple[DataFrame, float, float, float]:
    """``(i, x, y)`` with ``y = A x``, written to the checkpoint folder, and ``(eigenvalue,
    residual, norm of y)``, observed by the job that writes it.

    The sums are taken of ``d = y - shift x``, with the eigenvalue of the step before as the
    shift: near the end ``d`` is as small as the residual, so nothing cancels
    (``||y - e x||^2 = sum(d^2) - sum(x d)^2 / sum(x^2)`` for the Rayleigh quotient ``e``)."""
    y = a.multiply(VectorFrame(x, length, unique=True), layout=layout).df
    y = y.select("i", F.col("x").cast("double").alias("y"))
    both = y.join(x, "i", "full").select("i", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("x", "y")])
    x, y = F.col("x"), F.col("y")
    d = y - F.lit(shift) * x
    sums = Observation()
    both = both.observe(sums, F.sum(x * x).alias("xx"), F.sum(x * d).alias("xd"), F.sum(d * d).alias("dd"),
                        F.sum(y * y).alias("yy")).checkpoint()
    r = sums.get
    if not r.get("xx"):
        raise ValueError("the power method needs a start vector other than zero")
    value = shift + r["xd"] / r["xx"]
    if not math.isfinite(value) or not math.isfinite(r["yy"]):
        raise ValueError("the power method met a value that is not finite")
    rest = math.sqrt(max(0.0, r["dd"] - r["xd"] ** 2 / r["xx"]) / r["xx"])
    return both, value, rest, math.sqrt(r["yy"])


def power_method(a: MatrixFrame, x0: VectorFrame, tolerance: float = 1e-9, max_steps: int = 1000,
                 layout: str = "join", prepare: bool = True) -> Dominant:
    """The dominant eigenvalue and its vector, to ``residual <= tolerance``.

    A step is one action: the job that writes its product to ``spark.checkpoint.dir`` also
    sums up the Rayleigh quotient, the residual and the norm. A step therefore starts from
    files, plans do not grow with the steps, and a lost executor replays one step at most. The
    folder gets ``steps`` vectors; ``spark.cleaner.referenceTracking.cleanCheckpoints``
    lets Spark clear those no longer used. Only four numbers a step reach the driver.

    After ``max_steps`` the last estimate is returned with ``converged=False`` (two
    eigenvalues of equal size, or a gap too small). ``A x = 0`` is the eigenvalue 0. A zero
    or empty start vector, and values that are not finite, raise ``ValueError``."""
    if a.n_rows != a.n_cols:
        raise ValueError(f"the power method needs a square matrix, got {a.shape}")
    if max_steps < 1:
        raise ValueError("max_steps must be at least 1")
    checkpoint_dir(a.spark)
    owns = prepare and not a.is_prepared(layout)
    if owns:
        a.prepare(layout)
    try:
        x, length, value, scale = x0.canonical().df, x0.length, 0.0, 1.0
        x = x.select("i", F.col("x").cast("double").alias("x"))
        for k in range(1, max_steps + 1):
            both, value, rest, norm = _step(a, x, length, layout, value)
            residual = rest / abs(value) if value else (0.0 if norm == 0.0 else math.inf)
            done = residual <= tolerance
            if done or k == max_steps:
                if k == 1:   # later vectors have norm 1 already
                    scale = VectorFrame(both.select("i", "x"), a.n_rows, True).norm_value()
                unit = both.where("x <> 0").select("i", (F.col("x") / F.lit(scale)).alias("x"))
                return Dominant(value, VectorFrame(unit, a.n_rows, True), k, residual, done)
            x, length = both.where("y <> 0").select("i", (F.col("y") / F.lit(norm)).alias("x")), a.n_rows
    finally:
        if owns:
            a.unprepare(layout)
