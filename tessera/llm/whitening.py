"""Whitening of embeddings by the leading components of an exact, centred covariance.

Entries become whole numbers (``floor(64 c) + 1000000``), so sums and deviations are
exact. The fit list holds each distinct whole-number vector once: vectors travel as the
shortest integers that hold them, and repeated ones meet in the map-side combine, so a
vector that a third of the rows share is one row per task. It is written once and read in
three passes: sums, the covariance of centred vectors, and the covariance of the result.

Each task gives its partial square of sums one row per dimension; these meet in groups of
tasks first, so no group grows with the rows. The square itself (dimensions squared) is the
only thing the driver holds; its leading eigenpairs (``spectrum``) are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spectrum import EPS, leading_pairs

SCALE, SHIFT = 64.0, 1_000_000
BLOCK = 1 << 20  # entries per block of vectors
TASK_GROUPS = 1024  # partial sums of tasks meet in so many groups per dimension first


@dataclass
class Whitening:
    """A fitted model: ``n`` distinct vectors with sums ``total``, and the kept components."""

    n: int
    total: np.ndarray           # exact sums per dimension (long)
    values: np.ndarray          # eigenvalues, falling
    vectors: np.ndarray         # unit eigenvectors in columns
    explained: np.ndarray       # shares of the trace
    fit_list: DataFrame | None = None

    @property
    def dims(self) -> int:
        return len(self.total)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n x - total``, exact; a number beyond 64 bits fails."""
        if len(x) and float(np.abs(x).max()) * self.n + float(np.abs(self.total).max(initial=0)) >= 2.0 ** 63:
            raise OverflowError("whitening: n * x - sum does not fit in 64 bits")
        return x * np.int64(self.n) - self.total

    def scores(self, centred: np.ndarray) -> np.ndarray:
        """Centred vectors projected on the components, each divided by its deviation."""
        return (centred / float(self.n)) @ self.vectors / np.sqrt(self.values)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """Entries (doubles) as whole numbers; one that does not fit in 64 bits fails."""
    scaled = np.floor(SCALE * values)
    if len(values) and np.abs(scaled).max(initial=0) >= 2.0 ** 62:
        raise OverflowError("whitening: an entry does not fit in 64 bits")
    return scaled.astype(np.int64) + SHIFT


def _vectors(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """``(rows, vectors)``: which rows hold ``dims`` finite entries, and these as doubles."""
    size = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.nonzero(size == dims)[0]
    flat = column.take(pa.array(rows)).flatten().cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False).reshape(len(rows), dims)  # a null entry is NaN
    fine = np.isfinite(values).all(axis=1)
    return rows[fine], values[fine]


def _packed(x: np.ndarray) -> list[bytes]:
    """One key per vector: entries less ``SHIFT`` in the fewest bytes that hold the vector."""
    low = x - SHIFT
    top = np.maximum(low.max(axis=1), -1 - low.min(axis=1)) if x.shape[1] else np.zeros(len(x), np.int64)
    out: list[bytes] = [b""] * len(x)
    for code, kind in enumerate(("<i1", "<i2", "<i4", "<i8")):
        bits = 8 * np.dtype(kind).itemsize - 1
        mine = (top >> bits == 0) & ((top >> (bits // 2) != 0) if code else True)
        for n in np.nonzero(mine)[0].tolist():
            out[n] = b"%d" % code + low[n].astype(kind).tobytes()
    return out


def _unpacked(keys: list[bytes]) -> np.ndarray:
    kinds = ("<i1", "<i2", "<i4", "<i8")
    return np.stack([np.frombuffer(k, kinds[k[0] - 48], offset=1) for k in keys]).astype(np.int64) + SHIFT


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    step = max(1, BLOCK // max(1, dims))
    for b in batches:
        for s in range(0, b.num_rows, step):
            yield _unpacked(b.column(0).slice(s, step).to_pylist())


def common_length(vectors: DataFrame, vector_col: str) -> int:
    """The length that most non-null vectors have (the larger one of equally common ones); 0 if none."""
    v = F.col(vector_col)
    found = vectors.where(v.isNotNull() & (F.size(v) > 0)).groupBy(F.size(v).alias("size")).count()
    row = found.orderBy(F.desc("count"), F.desc("size")).first()
    return row["size"] if row else 0


def distinct_vectors(vectors: DataFrame, dims: int, vector_col: str) -> DataFrame:
    """``(key binary)``: every distinct whole-number vector once, written."""

    def run(batches):
        for b in batches:
            rows, values = _vectors(b.column(0), dims)
            yield pa.RecordBatch.from_arrays([pa.array(_packed(whole_numbers(values)), pa.binary())], ["key"])

    keys = vectors.select(F.col(vector_col).alias("v")).mapInArrow(run, "key binary")
    return cut(keys.distinct(), "whitening-fit")


def _summed(fit: DataFrame, dims: int, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the fit list of a square of ``width`` rows that ``part`` gives for a block."""

    def run(batches):
        total = np.zeros((width, width))
        for x in _blocks(batches, dims):
            total += part(x)
        group = TaskContext.get().partitionId() % TASK_GROUPS
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width), pa.int64()), pa.array([group] * width, pa.int64()),
             pa.array([r.tobytes() for r in total], pa.binary())], ["r", "g", "sums"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(width)
        for raw in rows.column("sums").to_pylist():
            total += np.frombuffer(raw)
        return pa.table({"r": rows.column("r").slice(0, 1), "g": rows.column("g").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "r long, g long, sums binary"
    rows = fit.mapInArrow(run, schema).groupBy("r", "g").applyInArrow(add, schema).groupBy("r").applyInArrow(add, schema)
    out = np.zeros((width, width))
    for row in rows.collect():
        out[row["r"]] = np.frombuffer(row["sums"])
    return out


def fit(vectors: DataFrame, components: int = 16, vector_col: str = "embedding") -> Whitening:
    """The model of ``vectors``: exact sums, covariance (divisor n) and its leading components.

    Null vectors and those with a null or non-finite entry are left out, and so are empty
    ones and those of another length than most (``common_length``). A component whose
    eigenvalue is zero to double precision cannot be whitened and is not kept, so
    a single vector, or none, gives a model without components."""
    dims = common_length(vectors, vector_col)
    none = Whitening(0, np.zeros(dims, np.int64), np.zeros(0), np.zeros((dims, 0)), np.zeros(0))
    if dims == 0:
        return none
    distinct = distinct_vectors(vectors, dims, vector_col)

    def sums(batches):
        n, total = 0, np.zeros(dims, np.int64)
        for x in _blocks(batches, dims):
            if float(np.abs(x).max()) * len(x) + float(np.abs(total).max()) >= 2.0 ** 63:
                raise OverflowError("whitening: sums do not fit in 64 bits")
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(dims)], pa.int64()), pa.array(np.r_[n, total], pa.int64())], ["d", "s"])

    # the sum of longs fails on overflow where ANSI mode is on; decimals hold any sum of them
    found = {r["d"]: int(r["s"]) for r in distinct.mapInArrow(sums, "d long, s long").groupBy("d").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    n = found.pop(-1, 0)
    if n == 0:
        return none
    model = Whitening(n, np.array([found[d] for d in range(dims)], np.int64), np.zeros(0), np.zeros((dims, 0)), np.zeros(0), distinct)

    def centred_square(x: np.ndarray) -> np.ndarray:
        y = model_only.centred(x) / float(n)
        return y.T @ y

    model_only = Whitening(n, model.total, model.values, model.vectors, model.explained)
    covariance = _summed(distinct, dims, centred_square, dims) / n
    covariance = (covariance + covariance.T) / 2
    values, basis = leading_pairs(covariance, components)
    kept = values > dims * EPS * max(values.max(initial=0), 0) * 16
    model.values, model.vectors = values[kept], basis[:, kept]
    model.explained = model.values / np.trace(covariance)
    return model


def identity_error(model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity."""
    k = len(model.values)
    if k == 0 or model.fit_list is None:
        return 0.0
    local = Whitening(model.n, model.total, model.values, model.vectors, model.explained)

    def square(x: np.ndarray) -> np.ndarray:
        z = local.scores(local.centred(x))
        return z.T @ z

    covariance = _summed(model.fit_list, model.dims, square, k) / model.n
    return float(np.abs(covariance - np.eye(k)).max())


def _exact_deviation(centred: np.ndarray) -> np.ndarray:
    """Sum of squares per row, exact; one beyond 64 bits fails."""
    top = np.abs(centred).max(initial=0)
    if float(top) ** 2 * centred.shape[1] < 2.0 ** 62:
        return (centred * centred).sum(axis=1)
    sums = [sum(c * c for c in row) for row in centred.tolist()]
    if sums and max(sums) >= 1 << 63:
        raise OverflowError("whitening: a deviation does not fit in 64 bits")
    return np.array(sums, np.int64)


def project(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, deviation long, whitened array<double>)`` of every usable row of ``vectors``.

    Rows that the fit leaves out (see ``fit``) are left out here; repeated rows come
    back repeated, a null id stays null, and other columns are not read. The projection is
    broadcast: dimensions times components."""
    spark = vectors.sparkSession
    local = spark.sparkContext.broadcast((model.n, model.total, model.values, model.vectors))
    dims, k = model.dims, len(model.values)
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>"

    def run(batches):
        n, total, values, basis = local.value
        m = Whitening(n, total, values, basis, np.zeros(0))
        step = max(1, BLOCK // max(1, dims))
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                rows, found = _vectors(b.column(1), dims)
                c = m.centred(whole_numbers(found))
                z = pa.array(m.scores(c).ravel())
                offsets = pa.array(np.arange(len(rows) + 1) * k, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array(_exact_deviation(c)), pa.ListArray.from_arrays(offsets, z)],
                    ["id", "deviation", "whitened"])

    if model.n == 0:
        return spark.createDataFrame([], schema)
    return src.mapInArrow(run, schema)


def whitened_components(vectors: DataFrame, components: int = 16, id_col: str = "vec_id",
                        vector_col: str = "embedding") -> DataFrame:
    """One row per usable vector and kept component.

    ``(vec_id, component from 1, n, deviation, whitened, explained, identity_error)``; see
    ``fit`` and ``project`` for nulls, lengths, ties and repeated rows. An empty table, or
    one whose vectors are all equal, gives no rows."""
    model = fit(vectors, components, vector_col)
    error = identity_error(model)
    shares = F.array(*[F.lit(float(x)) for x in model.explained]).cast("array<double>")
    each = project(vectors, model, id_col, vector_col).select(
        F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
