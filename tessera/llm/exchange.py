"""Rounds of packed rows between chunks of texts and buckets of hashes.

A chunk is a bounded run of rows, kept as one compressed Arrow stream in a written
table that is bucketed by chunk: a later pass finds the chunk's rows without moving
them. A round sends packed rows ``(chunk, bucket, keys, a, b)``, distinct within the
chunk, to one group per bucket, and the group's replies back to the chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.session import scratch_path

from .common import concat_batches, cut, shuffle_partitions

CHUNK_BYTES = 4 << 20
PACKED = "chunk long, bucket int, keys binary, a binary, b binary"


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """``(bucket, first, last)`` of the buckets that hold some of the sorted hashes."""
    b = bucket_of(sorted_hashes, buckets)
    first = np.nonzero(np.r_[True, b[1:] != b[:-1]])[0] if len(b) else np.zeros(0, np.int64)
    yield from zip(b[first].astype(np.int64).tolist(), first.tolist(), np.r_[first[1:], len(b)].tolist())


def packed_rows(chunk: int, rows: list[tuple]) -> pa.Table:
    """Packed rows ``(chunk, bucket, keys, a, b)``."""
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table({"chunk": pa.array([chunk] * len(rows), pa.int64()), "bucket": pa.array(list(cols[0]), pa.int32()),
                     **{n: pa.array(list(c), pa.binary()) for n, c in zip(("keys", "a", "b"), cols[1:])}})


def planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte: all lowest bytes, then all next ones. Bytes that are alike lie together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(blob: bytes, dtype: str) -> np.ndarray:
    """The numbers of ``planes``."""
    width = np.dtype(dtype).itemsize
    return np.frombuffer(blob, np.uint8).reshape(width, -1).T.copy().view(dtype).ravel()


def chunk_table(docs: DataFrame, name: str) -> DataFrame:
    """``(chunk, blob)``: rows in compressed Arrow streams, written once and bucketed by chunk."""
    spark = docs.sparkSession
    name = f"{name}_{uuid.uuid4().hex[:12]}"

    def run(batches):
        base, n = TaskContext.get().partitionId() << 32, 0
        for b in concat_batches(batches, CHUNK_BYTES):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array([base + n], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "blob"])
            n += 1

    rows = docs.mapInArrow(run, "chunk long, blob binary")
    (rows.write.option("path", scratch_path(spark, name)).option("compression", "none")
     .bucketBy(shuffle_partitions(spark), "chunk").saveAsTable(name))
    return spark.table(name)


def decoded(blob: bytes) -> pa.RecordBatch:
    """The rows of a chunk."""
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def merged(sent: DataFrame, merge: Callable[[pa.Table], pa.Table], name: str) -> DataFrame:
    """One group per bucket of the packed rows; the replies are written."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        return merge(rows)

    return cut(sent.groupBy("bucket").applyInArrow(run, PACKED), name)


def answered(chunks: DataFrame, replies: DataFrame, send: Callable[[bytes, int, pa.Table], pa.Table],
             out: T.StructType | str) -> DataFrame:
    """Every chunk with the replies to it (an empty table where there is none)."""

    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0:
            raise RuntimeError("a reply for a chunk that does not exist")
        return send(left.column("blob")[0].as_py(), key[0].as_py(), right)

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, out)
