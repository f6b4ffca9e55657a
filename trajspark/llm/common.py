"""Helpers that several operators share: byte-bounded slices of Arrow batches and tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at once. Only the memory of a task depends on it, no result.
SLICE_BYTES = 2 << 20
#: The same for work that takes many times the bytes of its text, in workers that go on to other tasks.
WORDS_BYTES = 256 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share. Unset only in tests: then a local one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="trajspark-")
        sc.setCheckpointDir(found)
    return found


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new table in the shared folder and read back: computed once, free of lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def offsets_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and UTF-8 bytes of a string column; a null has no bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    if column.null_count and (np.diff(at)[np.asarray(column.is_null())] > 0).any():  # bytes under a null
        return offsets_of(pa.array(["" if x is None else x for x in column.to_pylist()], column.type))
    return at, raw


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of at most `limit` bytes of text each, or one row."""
    for batch in batches:
        at, _ = offsets_of(batch.column(batch.schema.get_field_index(text)))
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi
