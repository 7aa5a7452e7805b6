"""What the batch functions of word operators hold in a Python worker while they run."""

from __future__ import annotations

import tracemalloc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pytest

from rillhouse.llm import collocations, decontaminate, ngram_join, sieve, sketch, substring_dedup, words

MB = 1 << 20


def _batch(megabytes: int) -> pa.RecordBatch:
    """Texts of about 2 KB, no two words alike within one."""
    draw = np.random.default_rng(7).integers(0, 1 << 40, (megabytes * 512, 250))
    texts = [" ".join(f"{x:07x}"[-7:] for x in row) for row in draw.tolist()]
    ids = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_pydict({"id": ids, "tag": ids, "text": texts})


def peak(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], batch: pa.RecordBatch) -> float:
    """MB of Python and numpy at most, with the tables of powers, which a new worker makes."""
    words._powers.clear()
    tracemalloc.start()
    for _ in run([batch]):
        pass
    most = tracemalloc.get_traced_memory()[1] / MB
    tracemalloc.stop()
    return most


def test_passages_hold_little():
    run = substring_dedup._passages(np.zeros(sketch.COUNTERS, np.uint8), 50, 8)
    assert peak(run, _batch(4)) < 30


def test_matching_holds_few_rows_as_python_numbers():
    n, size = 20_000, 60
    values = np.arange(n * size, dtype=np.int64) + (1 << 40)
    offsets = pa.array(np.arange(0, n * size + 1, size, dtype=np.int32))
    number = pa.array(np.arange(n), pa.int64())
    none = pa.array(np.zeros(n, np.int64))
    batch = pa.RecordBatch.from_pydict(
        {
            "anchor": number, "passage": number, "first": number, "shard": none,
            "part": pa.array(np.full(n, -1)), "role": none,
            "words": pa.ListArray.from_arrays(offsets, pa.array(values)),
        }
    )
    assert peak(substring_dedup._match(50), batch) < 10


def test_sets_and_keys_hold_little():
    batch, rare = _batch(4), np.zeros(sketch.COUNTERS, np.uint8)
    assert peak(ngram_join._sets, batch) < 20
    assert peak(ngram_join._pack(rare, 38, False), batch) < 20


def test_packed_rows_are_numbered_over_small_pieces():
    batch = _batch(1)
    packed = pa.Table.from_batches(list(ngram_join._pack(np.zeros(sketch.COUNTERS, np.uint8), 1, True)([batch])))
    ids = np.concatenate([np.frombuffer(x, np.int64) for x in packed.column("ids").to_pylist()])
    sizes = np.concatenate([np.frombuffer(x, np.uint32) for x in packed.column("sizes").to_pylist()])
    assert np.array_equal(np.bincount(ids), np.full(len(batch), 246))
    assert set(sizes.tolist()) == {246}


def test_same_hashes_whatever_the_tables():
    data = np.frombuffer(b"one two three " * 60_000, np.uint8)
    offsets = np.array([0, 400_000, len(data)])
    words._powers.clear()
    some = words.words_of(data, offsets)
    words._powers.clear()
    words._power_tables(1 << 21)
    assert np.array_equal(some.hashes, words.words_of(data, offsets).hashes)
    assert len(np.unique(some.hashes)) <= 5


def test_words_of_phrases_hold_little():
    batch = _batch(4)
    batch = batch.append_column("lang", pa.array(["en"] * len(batch)))
    assert peak(collocations._count_words, batch) < 55


def test_pairs_leave_in_small_batches():
    draw = np.random.default_rng(7).integers(0, 1 << collocations.NUMBER_BITS, (2, 1 << 21))
    rows = 0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal rows
        tiles = collocations.Tiles()
        for found in (tiles.add(0, *draw), tiles.rest()):
            for batch in found:
                rows += len(batch)
                assert len(batch) <= collocations.LEAVING
                yield batch

    assert peak(run, None) < 60
    assert rows > draw.shape[1] * 0.99


def test_phrases_and_test_items_bound_the_batches(spark, monkeypatch):
    class Asked(Exception):
        pass

    def stop(*_):
        raise Asked

    monkeypatch.setattr(collocations, "_texts", stop)
    monkeypatch.setattr(decontaminate, "F", None)
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    docs, before = spark.range(1), spark.conf.get(name)
    try:
        for ask in (collocations.phrases, lambda docs: decontaminate.contaminated(docs, docs)):
            spark.conf.set(name, default)
            with pytest.raises((Asked, AttributeError)):
                ask(docs)
            assert spark.conf.get(name) == str(4 << 20)
    finally:
        spark.conf.set(name, before)


def test_seeds_hold_little():
    batch = _batch(4)
    assert peak(decontaminate._hits(np.zeros(sieve.BITS // 8, np.uint8)), batch) < 20
    assert peak(decontaminate._item_seeds, batch.append_column("item", batch.column("id"))) < 20
