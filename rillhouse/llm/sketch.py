"""Frequency classes of 64-bit tokens from a count sketch of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rillhouse.llm.arrow import WORDS_BYTES, pieces

#: Counters of the sketch, whatever the corpus.
COUNTERS = 1 << 20
_BLOCK = 1 << 14
_SCHEMA = "block int, counts binary"


def _counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(40)).astype(np.int64) % COUNTERS


def _sum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, some in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = np.frombuffer(some, np.int64)
            blocks[i] = blocks[i] + counts if i in blocks else counts
    for i, counts in blocks.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": [counts.tobytes()]})


def frequency_classes(
    texts: DataFrame, tokens: Callable[[pa.RecordBatch], np.ndarray], sigmas: float, least: float
) -> tuple[np.ndarray, int]:
    """The class of each counter: 0 for rare tokens, and for frequent ones more by each doubling.

    With them, the number of all tokens counted.

    All texts are counted. A counter is frequent from ``sigmas`` standard deviations and ``least``
    counts above the mean; tokens that share a counter can only look more frequent than they are.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in pieces(batches, size=WORDS_BYTES):
            np.add.at(counts, _counter(tokens(batch)), 1)
        if counts.any():
            for i in range(0, COUNTERS, _BLOCK):
                some = counts[i : i + _BLOCK].tobytes()
                yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counts": [some]})

    parts = texts.select("text").mapInArrow(count, _SCHEMA).repartition(16, "block")
    counts = np.zeros(COUNTERS, np.int64)
    for row in parts.mapInArrow(_sum, _SCHEMA).collect():
        counts[row.block : row.block + _BLOCK] = np.frombuffer(row.counts, np.int64)
    mean = counts.mean()
    limit = mean + sigmas * np.sqrt(mean) + least
    classes = np.where(counts >= limit, 1 + np.log2(np.maximum(counts, 1) / limit), 0)
    return classes.astype(np.uint8), int(counts.sum())


def classes_of(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each token."""
    return classes[_counter(tokens)]
