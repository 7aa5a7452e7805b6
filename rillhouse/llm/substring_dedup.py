"""Removal of long repeated passages by suffix automata of reference shards.

A window is ``WINDOW`` consecutive words. Every word is removed that lies in a window whose words also
start in a document with a smaller id; windows are judged on the input.

1. Each window is assigned to its rarest ``ANCHOR`` consecutive words, by a fixed-size sketch of all
   such anchors and then by hash. Equal windows have equal anchors, wherever they stand. Neighbouring
   windows with one anchor make a passage; anchors of a single document are dropped.
2. Equal passages are one: for every document but the first that has it, all its windows are repeats.
3. The different passages of one anchor are the reference shard of that anchor. Shards are blocks of
   at most ``SHARD`` passages, so that a suffix automaton of one fits in memory; a larger anchor's
   passages are streamed against each of its blocks. The matching statistics of a passage say which
   of its windows stand in a shard, and the states' least owners whether in an earlier document.
4. Maximal spans of such windows are cut out of the texts.

An automaton goes only to the tasks whose passages share its anchor, not to all tasks. Words are
compared by 64-bit hashes. Null and empty texts have no words. Documents without an id have no place
in the order: they keep their words and take none from others. Rows with one id are judged each by
itself, and not against each other.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.arrow import WORDS_BYTES, lists, pieces, rows_of, small_batches, text_bytes
from rillhouse.llm.automaton import SuffixAutomaton
from rillhouse.llm.sieve import sieve, sifted
from rillhouse.llm.sketch import classes_of, frequency_classes
from rillhouse.llm.tables import written
from rillhouse.llm.words import row_sums, span_hashes, window_hashes, window_starts, words_of

WINDOW, ANCHOR = 50, 8
#: Windows of a passage at most: the bits of a mask.
MASK = 62
#: Passages of one automaton, and those whose words are held as Python numbers at once.
SHARD, ROWS = 256, 256
#: An anchor is frequent if its counter is this far above the mean, in standard deviations and counts.
SIGMAS, LEAST = 6.0, 32


def _anchors(batch: pa.RecordBatch) -> np.ndarray:
    words = words_of(*text_bytes(batch.column("text")))
    return window_hashes(words.hashes, window_starts(words.bounds, ANCHOR)[0], ANCHOR)


def _least_of(keys: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """The least of ``size`` consecutive keys from each start."""
    reach, found = 1, keys
    while 2 * reach <= size:
        found = np.minimum(found[: len(found) - reach], found[reach:])
        reach *= 2
    return np.minimum(found[starts], found[starts + size - reach])


def _passages(classes: np.ndarray, window: int, anchor: int):
    """The passages of each text: anchor, hash, first word, and windows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=WORDS_BYTES):
            words = words_of(*text_bytes(batch.column("text")))
            starts, counts = window_starts(words.bounds, window)
            if not len(starts):
                continue
            at = window_starts(words.bounds, anchor)[0]
            hashes = window_hashes(words.hashes, at, anchor)
            keys = np.full(len(words.hashes), np.iinfo(np.uint64).max, np.uint64)
            keys[at] = (classes_of(hashes, classes).astype(np.uint64) << np.uint64(58)) | (hashes >> np.uint64(6))
            least = _least_of(keys, starts, window - anchor + 1)
            rows = np.repeat(np.arange(len(counts)), counts)
            new = np.ones(len(starts), bool)
            new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
            first = np.flatnonzero(new)
            # A run of one anchor is no longer than the anchors of a window, unless the text repeats.
            length = np.diff(np.append(first, len(starts)))
            parts = -(-length // MASK)
            within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(first, parts) + within * MASK
            length = np.minimum(np.repeat(length, parts) - within * MASK, MASK)
            start = starts[first]
            hashed = span_hashes(words.hashes, start, start + length + window - 1)
            row = rows[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least[first].view(np.int64)),
                    pa.array(hashed.view(np.int64)),
                    batch.column("id").take(pa.array(row)),
                    batch.column("tag").take(pa.array(row)),
                    pa.array((start - words.bounds[row]).astype(np.int32)),
                    pa.array(length.astype(np.int32)),
                ],
                names=["anchor", "passage", "id", "tag", "start", "n"],
            )

    return run


PASSAGES = "anchor long, passage long, id long, tag long, start int, n int"


def _spell(window: int):
    """The words of the chosen passages of each text, as hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=WORDS_BYTES):
            words = words_of(*text_bytes(batch.column("text")))
            out, values = [], []
            for row, chosen in enumerate(batch.column("chosen").to_pylist()):
                base = int(words.bounds[row])
                for x in chosen:
                    start = base + x["start"]
                    out.append((x["anchor"], x["passage"], x["blocks"], batch.column("id")[row].as_py()))
                    values.append(words.hashes[start : start + x["n"] + window - 1])
            sizes = np.array([len(v) for v in values], np.int64)
            flat = np.concatenate(values) if values else np.empty(0, np.uint64)
            columns = [pa.array([x[i] for x in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*columns, lists(flat.view(np.int64), sizes, pa.int64())],
                names=["anchor", "passage", "blocks", "first", "words"],
            )

    return run


def _match(window: int):
    """Masks of the windows of each streamed passage that stand in an earlier document.

    Rows are sorted by (anchor, shard, part, role): the shard's own passages, role 0, come first.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton, own, finished = None, SuffixAutomaton(), [], False

        def stream(anchor, passage, first, sequence):
            mask = 0
            for end, owner in automaton.matches(sequence, window):
                if owner < first:
                    mask |= 1 << (end - window)
            return (anchor, passage, mask) if mask else None

        def close():
            """Streams the shard's own passages, if it is the only one of its anchor."""
            if not finished:
                automaton.finish()
            return [x for x in (stream(*p) for p in own) if x]

        for batch in rows_of(batches, ROWS):
            found = []
            names = ("anchor", "passage", "first", "shard", "part", "role", "words")
            for a, p, first, shard, part, role, sequence in zip(*(batch.column(c).to_pylist() for c in names)):
                if group != (a, shard, part):
                    found += close()
                    group, automaton, own, finished = (a, shard, part), SuffixAutomaton(), [], False
                if role == 0:
                    automaton.add(sequence, first)
                    if part < 0:
                        own.append((a, p, first, sequence))
                else:
                    if not finished:
                        automaton.finish()
                        finished = True
                    found.append(stream(a, p, first, sequence))
            yield _masks([x for x in found if x])
        yield _masks(close())

    return run


def _masks(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([x[i] for x in found], pa.int64()) for i in range(3)], names=["anchor", "passage", "mask"]
    )


def _cut(window: int):
    """The kept words of each text, joined by one space."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=WORDS_BYTES):
            data, offsets = text_bytes(batch.column("text"))
            words = words_of(data, offsets)
            steps = np.zeros(len(words.hashes) + 1, np.int64)
            for row, spans in enumerate(batch.column("spans").to_pylist()):
                for x in spans or ():
                    bits = x["mask"]
                    base = int(words.bounds[row]) + x["start"]
                    while bits:
                        low = (bits & -bits).bit_length() - 1
                        run_length = (~(bits >> low) & ((bits >> low) + 1)).bit_length() - 1
                        steps[base + low] += 1
                        steps[base + low + run_length + window - 1] -= 1
                        bits &= ~(((1 << run_length) - 1) << low)
            kept = np.cumsum(steps)[:-1] <= 0
            left = row_sums(kept, words.bounds)
            starts, sizes = words.starts[kept], (words.ends - words.starts)[kept] + 1
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)
            text = np.append(data, np.uint8(32))[at]
            text[ends - 1] = 32
            # Without the space behind the last word of each text.
            last = np.cumsum(left)[left > 0] - 1
            solid = np.ones(len(text), bool)
            solid[ends[last] - 1] = False
            length = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(left)])]
            length = np.diff(length) - (left > 0)
            joined = pa.Array.from_buffers(
                pa.large_string(),
                len(batch),
                [
                    None,
                    pa.py_buffer(np.concatenate([[0], np.cumsum(length)]).astype(np.int64)),
                    pa.py_buffer(np.ascontiguousarray(text[solid])),
                ],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(words.counts, pa.int64()),
                    pa.array(words.counts - left, pa.int64()),
                    joined.cast(pa.string()),
                ],
                names=["id", "n_words", "n_removed", "kept"],
            )

    return run


def _verdicts(occurrences: DataFrame, texts: DataFrame, window: int, shard: int) -> DataFrame:
    """(anchor, passage, first, mask): the first document, and its windows that stand earlier still."""
    passages = occurrences.groupBy("anchor", "passage").agg(
        F.min(F.struct("id", "tag", "start", "n")).alias("first")
    )
    passages = written(passages, "passages")
    kinds = passages.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    chosen = passages.join(kinds, "anchor").select(
        F.col("first.id").alias("id"),
        F.col("first.tag").alias("tag"),
        F.struct(
            "anchor", "passage", "first.start", "first.n", F.ceil(F.col("kinds") / shard).alias("blocks")
        ).alias("x"),
    )
    chosen = written(chosen.groupBy("id", "tag").agg(F.collect_list("x").alias("chosen")), "chosen")
    few = sifted(texts, "id", sieve(chosen, "id")).join(chosen, ["id", "tag"])
    spelled = few.dropDuplicates(["id", "tag"]).select("id", "text", "chosen").mapInArrow(
        _spell(window), "anchor long, passage long, blocks long, first long, words array<long>"
    )
    spelled = written(spelled, "spelled")
    own = F.pmod("passage", "blocks")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    single = spelled.where("blocks = 1").withColumns(
        {"shard": F.lit(0).cast("long"), "part": F.lit(-1).cast("long"), "role": F.lit(0)}
    )
    many = spelled.where("blocks > 1")
    shards = many.withColumns({"shard": own, "part": F.explode(every), "role": F.lit(0)})
    streams = many.withColumns({"part": own, "shard": F.explode(every), "role": F.lit(1)})
    rows = single.unionByName(shards).unionByName(streams).drop("blocks")
    rows = rows.repartition("anchor", "shard", "part")
    masks = rows.sortWithinPartitions("anchor", "shard", "part", "role").mapInArrow(
        _match(window), "anchor long, passage long, mask long"
    )
    masks = masks.groupBy("anchor", "passage").agg(F.bit_or("mask").alias("mask"))
    first = passages.select("anchor", "passage", F.col("first.id").alias("first"))
    return first.join(masks, ["anchor", "passage"], "left")


def remove_repeats(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    shard: int = SHARD,
) -> DataFrame:
    """(key, n_words, n_removed, kept): the kept words of each text, joined by one space."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    texts = texts.withColumn("tag", F.xxhash64("text"))
    classes, _ = frequency_classes(texts, _anchors, SIGMAS, LEAST)
    found = texts.where("id is not null").mapInArrow(_passages(classes, window, anchor), PASSAGES)
    shared = found.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    occurrences = found.join(shared.where("low < high").select("anchor"), "anchor").distinct()
    occurrences = written(occurrences, "occurrences")
    verdicts = _verdicts(occurrences, texts, window, shard)
    whole = F.expr("shiftleft(1L, n) - 1")
    mask = F.when(F.col("id") > F.col("first"), whole).otherwise(F.coalesce("mask", F.lit(0)))
    spans = (
        occurrences.join(verdicts, ["anchor", "passage"])
        .select("id", "tag", "start", mask.alias("mask"))
        .where("mask != 0")
        .groupBy("id", "tag")
        .agg(F.collect_list(F.struct("start", "mask")).alias("spans"))
    )
    spans = written(spans, "spans")
    bitmap = sieve(spans, "id")
    hit = sifted(texts, "id", bitmap).join(spans, ["id", "tag"], "left").select("id", "text", "spans")
    kind = spans.schema["spans"].dataType
    miss = sifted(texts, "id", bitmap, out=True).select("id", "text", F.lit(None).cast(kind).alias("spans"))
    schema = "id long, n_words long, n_removed long, kept string"
    kept = hit.mapInArrow(_cut(window), schema).unionByName(miss.mapInArrow(_cut(window), schema))
    return kept.withColumnRenamed("id", key)
