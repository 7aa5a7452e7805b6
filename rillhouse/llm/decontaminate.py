"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Texts are read as words of letters and digits, A-Z in lower case. The seeds of a test item are its
``SEED``-word sequences; a document that holds any of them, rare or common, is joined to the item. The
passages around an item's seeds in a document are aligned with the item: a match scores 1, a mismatch
or a gap costs ``PENALTY``. A document is contaminated from ``THRESHOLD`` of the score of an exact copy
on, but not below ``LEAST`` points (for short items: below ``SHORT`` of the exact score); ``RUN`` points
are enough however long the item is. A copy that keeps no ``SEED`` words in a row is not found.

A seed joins all its documents to all its items, so common seeds give many pairs. Most of these end at
a bound of the score, which costs little and never lies below it; only the others are aligned.

Null and empty texts, and items of fewer words than a seed, match nothing. Rows without an id are left out, as
the result could not name them; rows with the same ids give one row for each item, the best one.
Items may repeat. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.arrow import WORDS_BYTES, pieces, small_batches, text_bytes
from rillhouse.llm.sieve import BITS, sieve, sifted
from rillhouse.llm.tables import written
from rillhouse.llm.words import Words, mix, window_hashes, window_starts, words_of

SEED = 3
PENALTY = 0.5
THRESHOLD, RUN = 0.4, 30.0
LEAST, SHORT = 8.0, 0.8
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def _words(column: pa.Array) -> Words:
    data, offsets = text_bytes(column)
    return words_of(_PLAIN[data], offsets)


def _seeds(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of each text and the text of each."""
    starts, counts = window_starts(words.bounds, SEED)
    return window_hashes(words.hashes, starts, SEED), np.repeat(np.arange(len(counts)), counts)


def needed(words: int) -> float:
    """The score that contaminates, for an item of so many words."""
    return min(max(THRESHOLD * words, min(LEAST, SHORT * words)), RUN)


def _item_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, size=WORDS_BYTES):
        keys, rows = _seeds(_words(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), batch.column("item").take(pa.array(rows))], names=["seed", "item"]
        )


def _hits(bitmap: np.ndarray):
    """(seed, id) of the sequences of each text that may be seeds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.uint64(len(bitmap) * 8)
        for batch in pieces(batches, size=WORDS_BYTES):
            keys, rows = _seeds(_words(batch.column("text")))
            at = mix(keys) % bits
            byte = bitmap[(at >> np.uint64(3)).astype(np.int64)]
            hit = np.flatnonzero((byte >> (at & np.uint64(7)).astype(np.uint8)) & 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[hit].view(np.int64)), batch.column("id").take(pa.array(rows[hit]))],
                names=["seed", "id"],
            )

    return run


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment score of two word sequences, and its span in the passage."""
    n = len(passage)
    steps = PENALTY * np.arange(n + 1)
    row, start = np.zeros(n + 1), np.arange(n + 1)
    best = (0.0, 0, 0)
    for word in item:
        move = np.where(passage == word, 1.0, -PENALTY)
        new, came = np.zeros(n + 1), np.arange(n + 1)
        diagonal = row[:-1] + move
        better = diagonal > 0
        new[1:][better], came[1:][better] = diagonal[better], start[:-1][better]
        up = row - PENALTY
        better = up > new
        new[better], came[better] = up[better], start[better]
        # A gap in the item: the best of all earlier columns, less the way from there.
        lifted = new + steps
        reach = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted >= reach, np.arange(n + 1), 0))
        gap = reach - steps
        better = gap > new + 1e-12
        new[better], came[better] = gap[better], came[source[better]]
        row, start = new, came
        at = int(row.argmax())
        if row[at] > best[0]:
            best = (float(row[at]), int(start[at]), at)
    return best


def bound(item: np.ndarray, passage: np.ndarray) -> float:
    """No alignment scores more: words that the other side lacks cost ``PENALTY`` each, others give 1."""
    most = np.inf
    for words, others in ((passage, item), (item, passage)):
        sums = np.cumsum(np.where(np.isin(words, others), 1.0, -PENALTY))
        before = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
        most = min(most, float((sums - before).max(initial=0.0)))
    return most


def _align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, size=WORDS_BYTES):
        words, items = _words(batch.column("text")), _words(batch.column("item_text"))
        found = []
        for row in range(len(batch)):
            mine = words.hashes[words.bounds[row] : words.bounds[row + 1]]
            item = items.hashes[items.bounds[row] : items.bounds[row + 1]]
            if min(len(mine), len(item)) < SEED:
                continue
            seeds = window_hashes(item, np.arange(len(item) - SEED + 1), SEED)
            at = np.flatnonzero(np.isin(window_hashes(mine, np.arange(len(mine) - SEED + 1), SEED), seeds))
            if not len(at):
                continue
            best = (0.0, 0, 0)
            # Passages: seeds that are no further apart than the item is long.
            for some in np.split(at, np.flatnonzero(np.diff(at) > len(item)) + 1):
                low = max(0, int(some[0]) - len(item))
                passage = mine[low : int(some[-1]) + SEED + len(item)]
                if bound(item, passage) < needed(len(item)):
                    continue
                score, start, end = align(item, passage)
                if score > best[0]:
                    best = (score, low + start, low + end)
            if best[0] >= needed(len(item)):
                found.append((row, best[0] / len(item), best[1], best[2]))
        rows = pa.array([x[0] for x in found], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id").take(rows),
                batch.column("item").take(rows),
                *(pa.array([x[i] for x in found], t) for i, t in ((1, pa.float64()), (2, pa.int64()), (3, pa.int64()))),
            ],
            names=["id", "item", "score", "start", "end"],
        )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(key, item, score, start, end) of the documents that contain a test item; the span is in words."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null")
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text")).where("item is not null")
    kind = items.schema["item"].dataType.simpleString()
    seeds = written(items.mapInArrow(_item_seeds, f"seed long, item {kind}").distinct(), "seeds")
    bitmap = sieve(seeds, "seed", BITS)
    # Pairs of a seed and a document, whatever the number of their occurrences.
    hits = texts.mapInArrow(_hits(bitmap), "seed long, id long").distinct()
    pairs = written(hits.join(seeds, "seed").select("id", "item").distinct(), "candidates")
    few = sifted(texts, "id", sieve(pairs, "id"))
    # Items go to the pairs first: the longer texts of documents are shuffled once, not for each item.
    rows = few.join(pairs.join(items.withColumnRenamed("text", "item_text").distinct(), "item"), "id")
    found = rows.select("id", "text", "item", "item_text").mapInArrow(
        _align, f"id long, item {kind}, score double, start long, end long"
    )
    best = found.groupBy("id", "item").agg(F.max(F.struct("score", "start", "end")).alias("best"))
    return best.select(
        F.col("id").alias(key), F.col("item").alias(item), "best.score", "best.start", "best.end"
    )
