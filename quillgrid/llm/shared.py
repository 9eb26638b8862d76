"""Helpers the operators of this folder share: stable intermediate results and bounded batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that a Python worker handles at a time.
SLICE_BYTES = 4 << 20


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset and Spark runs locally."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillgrid-"))
    return sc.getCheckpointDir().rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name below the shared root."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage at a reliable checkpoint, so that a lost executor costs a reread and nothing is computed twice."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder. Spark knows a table's size, and may broadcast a small one."""
    path = shared_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give a finished task's free memory back; the worker waits for further tasks while other stages use the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def text_slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows of about SLICE_BYTES of text; a single longer text is a run of its own."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < len(sizes):
            limit = (ends[start - 1] if start else 0) + SLICE_BYTES
            stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def text_array(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column's values, null as empty."""
    return pc.fill_null(batch.column(column), "")


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's values, null as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()
