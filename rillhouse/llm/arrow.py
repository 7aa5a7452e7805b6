"""Arrow helpers of the batch functions: text columns as bytes, batches in small pieces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that a batch function works on at once; a longer text comes alone.
PIECE_BYTES = 1 << 20
#: The same where each byte of text takes many bytes of arrays, as words and their hashes do.
WORDS_BYTES = 1 << 18
#: Bytes of an Arrow batch on its way to a Python worker and back, where the session keeps Spark's default.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = 64 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches hold ``BATCH_BYTES`` or one row, unless it has its own bound."""
    if int(spark.conf.get(_BATCH_SETTING).rstrip("b")) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.empty(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(
    batches: Iterable[pa.RecordBatch], text: str = "text", size: int = PIECE_BYTES
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts together hold at most ``size`` bytes, or one row."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        start = 0
        while start < len(batch):
            end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
            end = min(max(end, start + 1), len(batch))
            yield batch.slice(start, end - start)
            start = end


def rows_of(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of ``counts`` values a row."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binaries(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column: the bytes of ``counts`` values a row."""
    values = np.ascontiguousarray(values)
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    offsets *= values.itemsize
    return pa.Array.from_buffers(
        pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(values)]
    )
