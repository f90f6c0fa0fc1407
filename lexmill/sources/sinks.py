"""Sinks of token ids: flat files and packed arrays, a file for each partition, written where the partition is.

Rows are dealt into ranges of an order column, so the files, by name, hold the
ids in that order. A task writes under a name of its own and renames the
file when it is whole, so a task that runs twice leaves one file. Paths are those
that pyarrow's file systems and Spark both reach.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WRITTEN = "part int, rows long, n long"


def _put(base: str, name: str, chunks: Iterator[bytes]) -> None:
    where, root = fs.FileSystem.from_uri(base)
    where.create_dir(root, recursive=True)
    temp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(temp) as out:
        for c in chunks:
            out.write(c)
    where.move(temp, f"{root}/{name}")


def _checked(ids: np.ndarray, dtype: str) -> np.ndarray:
    if len(ids) and (ids.min() < 0 or ids.max() > np.iinfo(dtype).max):
        raise OverflowError(f"id {ids.max()} in {dtype}")
    return ids.astype(np.dtype(dtype).newbyteorder("<"))


def write_flat(rows: DataFrame, path: str, dtype: str = "uint16", order: str = "doc_id") -> DataFrame:
    """Ids of rows (order, ids) one after the other as little-endian numbers, part-00000.bin and so on under path; what was written (part, rows, n). An id that dtype doesn't hold is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = TaskContext.get().partitionId(), [0, 0]

        def chunks() -> Iterator[bytes]:
            for b in batches:
                ids = _checked(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype)
                sums[0] += b.num_rows
                sums[1] += len(ids)
                yield ids.tobytes()

        _put(path, f"part-{part:05d}.bin", chunks())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums[0]]), pa.array([sums[1]])], ["part", "rows", "n"])

    return rows.select(order, "ids").repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, WRITTEN)


def read_flat(spark: SparkSession, path: str, dtype: str = "uint16") -> DataFrame:
    """(part, ids) of the files of write_flat(), one row a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, np.dtype(dtype).newbyteorder("<")).astype(np.int64) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int64()))], ["part", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.bin").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "content").mapInArrow(run, "part int, ids array<long>")


def write_npy(packed: DataFrame, path: str, dtype: str = "uint16", order: str = "seq") -> DataFrame:
    """Sequences of one length (order, ids) as NumPy arrays of two dimensions, a file for each range of order; what was written. A range is held in memory by its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blocks, rows = TaskContext.get().partitionId(), [], 0
        for b in batches:
            if b.num_rows:
                rows += b.num_rows
                blocks.append(_checked(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype).reshape(b.num_rows, -1))
        array = np.concatenate(blocks) if blocks else np.zeros((0, 0), dtype)
        out = io.BytesIO()
        np.save(out, array)
        _put(path, f"part-{part:05d}.npy", iter([out.getvalue()]))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([rows]), pa.array([array.size])], ["part", "rows", "n"])

    return packed.select(order, "ids").repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, WRITTEN)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(part, row, ids) of the files of write_npy()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(raw))
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(a), pa.int32()), pa.array(np.arange(len(a))), pa.array(list(a.astype(np.int64)), pa.list_(pa.int64()))], ["part", "row", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.npy").load(path)
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "content").mapInArrow(run, "part int, row long, ids array<long>")


def put_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, as of a vocabulary, on any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(data))
    out.close()
