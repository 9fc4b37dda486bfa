"""Helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one vectorised step of a Python worker holds at a time.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """The frame, written once to the cluster's shared checkpoint folder.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a session on one machine gets a folder of
    its own, and a cluster an error: executors would not see a local folder. The files outlive any executor, so
    later stages never recompute.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="palisade-checkpoint-"))
    return df.checkpoint(eager=True)


#: Rows of the batches that executors and Python workers exchange.
BATCH_ROWS = 1_024


def lean(df: DataFrame) -> DataFrame:
    """The same frame. Its session sends Python workers at most BATCH_ROWS rows at a time from now on.

    A batch is held on both sides, by every task at once, and rows here are whole texts.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)
    return df


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small frame of plain values, planned inside the JVM (no Python rows are shipped to executors)."""
    import json

    return (
        spark.range(1)
        .select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
    )


def as_binary(column: pa.Array) -> pa.Array:
    """Strings (or bytes) as one contiguous binary array; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: (first row, last row + 1, bytes, offsets from 0).

    A row longer than the limit comes alone and whole.
    """
    column = as_binary(column)
    n = len(column)
    if not n:
        return
    _, offsets_buffer, data = column.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64, n + 1 + column.offset)[column.offset :]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(first + 1, last))
        own = offsets[first : last + 1]
        yield first, last, flat[own[0] : own[-1]], own - own[0]
        first = last


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows of about `limit` bytes: (first row, last row + 1, texts); null becomes empty."""
    for first, last, _, _ in byte_slices(column, limit):
        yield first, last, [t or "" for t in column.slice(first, last - first).to_pylist()]


def frugal(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work; when a task ends, memory that it has freed goes back to the system.

    Python workers are reused from task to task and stage to stage, and allocators keep what was freed.
    """

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release_memory()

    return done


def release_memory() -> None:
    """Gives freed memory back to the system (where the C library is glibc; else only Arrow's)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
