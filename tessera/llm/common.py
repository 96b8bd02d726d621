"""Helpers shared by the operators: written cuts of a plan, Arrow batches, hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import scratch_path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    The plan above starts at the written files, so a lost executor repeats only
    reads of shared storage, and the rows are not computed again by each reader.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_fold(column: str, mod: int) -> Column:
    """``crc32`` of an id written as text, modulo ``mod`` (null ids: null)."""
    return (F.crc32(F.col(column).cast("string")) % F.lit(mod)).cast("int")


def free(name: str, columns: Iterable[str]) -> str:
    """``name``, with underscores added until no column has it (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and n+1 offsets (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        width = np.int64
    else:
        width = np.int32
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        empty = pa.scalar(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "", col.type)
        col = col.fill_null(empty)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, width)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def byte_rows(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The UTF-8 bytes of every row of a string column (null: empty)."""
    data, off = utf8_column(batch, name)
    whole = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield whole[a:b]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 steps), vectorised."""
    x = np.array(x, np.uint64)
    high = np.empty_like(x)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, np.uint64(shift), out=high)
        x ^= high
        x *= np.uint64(factor)
    np.right_shift(x, np.uint64(31), out=high)
    x ^= high
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words from a seed (a counter through ``mix64``)."""
    with np.errstate(over="ignore"):
        base = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(base + mix64(np.array([seed], np.uint64)))


_KEPT: list[tuple[Hashable, Any]] = []


def kept(name: Hashable, make: Callable[[], Any]) -> Any:
    """A worker's one large thing that outlives its task (a cache, an encoder).

    Workers are used again by later stages; asking for another name drops the thing kept
    before, so what stages leave behind does not add up."""
    if not _KEPT or _KEPT[0][0] != name:
        _KEPT.clear()
        give_back()
        _KEPT.append((name, make()))
    return _KEPT[0][1]


def give_back() -> None:
    """Freed memory of this worker goes back to the system, where its allocators can do so."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def concat_batches(batches: Iterable[pa.RecordBatch], max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches put together or cut to about ``max_bytes`` each (one row at least)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        step = max(1, int(b.num_rows * max_bytes / max(1, b.nbytes)))
        for s in range(0, b.num_rows, step):
            part = b.slice(s, step)
            grows = b.nbytes * part.num_rows / max(1, b.num_rows)
            if held and size + grows > max_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += grows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes under the links ``u - v``."""
    label = np.arange(n)
    if len(u) == 0:
        return label
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        np.minimum.at(label, before[u], low)
        np.minimum.at(label, before[v], low)
        label = label[label]
        if np.array_equal(label, before):
            return label
