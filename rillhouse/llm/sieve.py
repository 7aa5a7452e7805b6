"""A bounded set of ids for dropping rows early; what passes is joined exactly afterwards."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.words import mix

#: Bits of the set: it is sent to every task, whatever the number of ids.
BITS = 1 << 24


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def sieve(ids: DataFrame, key: str, bits: int = BITS) -> np.ndarray:
    """A bitmap of the hashed ids (a long column); its size does not depend on their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(bits, bool)
        for batch in batches:
            found[_places(batch.column(0).to_numpy(), bits)] = True
        block = 1 << 15
        for i in np.flatnonzero(found.reshape(-1, min(block, bits)).any(axis=1)).tolist():
            packed = np.packbits(found[i * block : (i + 1) * block], bitorder="little").tobytes()
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "bits": [packed]})

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                some = np.frombuffer(packed, np.uint8)
                blocks[i] = blocks[i] | some if i in blocks else some
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(blocks), pa.int32()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())],
            names=["block", "bits"],
        )

    schema = "block int, bits binary"
    parts = ids.select(F.col(key).cast("long")).where(F.col(key).isNotNull()).mapInArrow(run, schema)
    whole = np.zeros(bits, bool)
    for row in parts.repartition(16, "block").mapInArrow(merge, schema).collect():
        some = np.unpackbits(np.frombuffer(row.bits, np.uint8), bitorder="little").astype(bool)
        whole[row.block * (1 << 15) :][: len(some)] |= some
    return np.packbits(whole, bitorder="little")


def sifted(rows: DataFrame, key: str, bitmap: np.ndarray, out: bool = False) -> DataFrame:
    """The rows whose id may be in the set: all that are, and some that are not.

    ``out`` gives the other rows instead, those with a null id among them.
    """
    bits = len(bitmap) * 8
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(key)
            at = _places(column.fill_null(0).to_numpy(zero_copy_only=False), bits)
            hit = (shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            hit &= column.is_valid().to_numpy(zero_copy_only=False)
            hit ^= out
            if hit.any():
                yield batch.filter(pa.array(hit))

    return rows.mapInArrow(run, rows.schema)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose id (a long) is not among ``ids``; only rows that may be are shuffled."""
    bitmap = sieve(ids, key)
    suspects = sifted(rows, key, bitmap).join(ids.select(key).distinct(), key, "left_anti")
    return sifted(rows, key, bitmap, out=True).unionByName(suspects)
