"""Token-id files of patched frame-of-reference blocks.

Documents are laid out in ascending order of their id over files, each written by one task. A file
is a run of segments, each with its own length in front::

    segment  magic b"PFR1", then unsigned 32-bit: bytes of the segment, documents, blocks, block size
             documents: signed 64-bit ids, unsigned 32-bit token counts
             block index: unsigned 32-bit start of each block from the segment's start
             blocks
    block    unsigned 32-bit minimum; unsigned 16-bit values, exceptions; byte width; 3 bytes zero
             values less the minimum, the low ``width`` bits of each, packed
             exceptions: unsigned 16-bit positions, unsigned 32-bit high parts

A block subtracts its minimum, packs at the width that a percentile of its values needs, and keeps
the high bits of wider values in the exception list. The block index lets a reader decode any range
of tokens by itself. The ids are those of the tokenizer as its file has it, without special tokens at
the ends; where a text holds an added token such as ``<|endoftext|>``, it has that token's id, as the
library gives it. Files are committed by Spark's writer and read whole by its binary reader, so
they may lie in any store; their names and order are free, since ids order them.
"""

from __future__ import annotations

import functools
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from rillhouse.llm.arrow import binaries, pieces, text_bytes
from rillhouse.llm.words import words_of

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
BLOCK = 1024
#: Share of a block's values that must fit the packed width.
PERCENTILE = 0.95
#: Distinct words whose ids one worker remembers.
REMEMBERED = 500_000
#: Text bytes for each file of a written table.
FILE_BYTES = 32 << 20
#: Text bytes of a segment, or one document.
SEGMENT_BYTES = 2 << 20
#: Stands for a null id.
NO_ID = -(1 << 63)
_LETTER = np.array([chr(i).isascii() and chr(i).isalpha() for i in range(256)])
_MARK = np.array([i < 127 and chr(i).isprintable() and not chr(i).isalnum() and i != 32 for i in range(256)])
#: Changes the hashes of added tokens.
_ADDED = np.uint64(0x5851F42D4C957F2D)
_HEAD = struct.Struct("<4s4I")
_BLOCK_HEAD = struct.Struct("<I2HB3x")
MAGIC = b"PFR1"


def pack_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of unsigned 32-bit values."""
    low = int(values.min()) if len(values) else 0
    rest = values.astype(np.uint32) - np.uint32(low)
    kept = np.partition(rest, at)[at] if (at := int(percentile * (len(rest) - 1))) >= 0 and len(rest) else 0
    width = int(kept).bit_length()
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    odd = np.flatnonzero(high)
    return b"".join(
        (
            _BLOCK_HEAD.pack(low, len(rest), len(odd), width),
            packed,
            odd.astype("<u2").tobytes(),
            high[odd].astype("<u4").tobytes(),
        )
    )


def unpack_block(data: memoryview, at: int) -> np.ndarray:
    """The values of the block at a byte position."""
    low, n, odd, width = _BLOCK_HEAD.unpack_from(data, at)
    at += _BLOCK_HEAD.size
    size = (n * width + 7) // 8
    bits = np.unpackbits(
        np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little"
    ).reshape(n, width)
    values = np.zeros(n, np.uint32)
    for i in range(width):
        values |= bits[:, i].astype(np.uint32) << np.uint32(i)
    at += size
    where = np.frombuffer(data, "<u2", odd, at)
    high = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    values[where] |= high << np.uint32(width)
    return values + np.uint32(low)


def pack_segment(ids: np.ndarray, counts: np.ndarray, tokens: np.ndarray, block: int = BLOCK) -> bytes:
    """A segment of whole documents."""
    blocks = [pack_block(tokens[i : i + block]) for i in range(0, len(tokens), block)]
    before = _HEAD.size + 12 * len(ids) + 4 * len(blocks)
    sizes = np.array([0, *map(len, blocks)], np.int64)
    index = (before + np.cumsum(sizes)[: len(blocks)]).astype("<u4")
    body = [ids.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), index.tobytes(), *blocks]
    size = before + int(sizes.sum())
    return _HEAD.pack(MAGIC, size, len(ids), len(blocks), block) + b"".join(body)


def segments(data: memoryview) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, counts, tokens) of each segment of a file."""
    at = 0
    while at < len(data):
        magic, size, docs, blocks, _ = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError(f"no segment at byte {at}")
        start = at + _HEAD.size
        ids = np.frombuffer(data, "<i8", docs, start)
        counts = np.frombuffer(data, "<u4", docs, start + 8 * docs)
        index = np.frombuffer(data, "<u4", blocks, start + 12 * docs)
        parts = [unpack_block(data, at + int(x)) for x in index]
        yield ids, counts, np.concatenate(parts) if parts else np.empty(0, np.uint32)
        at += size + 1  # the writer ends each record with a line feed


def _extent(data: memoryview) -> tuple[int | None, int]:
    """The first id of a file and its tokens."""
    at, size, first = 0, 0, None
    while at < len(data):
        _, length, docs, _, _ = _HEAD.unpack_from(data, at)
        counts = np.frombuffer(data, "<u4", docs, at + _HEAD.size + 8 * docs)
        if first is None and docs:
            first = int(np.frombuffer(data, "<i8", 1, at + _HEAD.size)[0])
        size += int(counts.sum(dtype=np.int64))
        at += length + 1
    return first, size


def tokens_at(data: memoryview, start: int, stop: int) -> np.ndarray:
    """Tokens ``start`` to ``stop`` of the segment at the start of ``data``, from their blocks alone."""
    _, _, docs, _, block = _HEAD.unpack_from(data, 0)
    index = np.frombuffer(data, "<u4", -(-stop // block), _HEAD.size + 12 * docs)
    parts = [unpack_block(data, int(x)) for x in index[start // block :]]
    first = start // block * block
    return np.concatenate(parts)[start - first : stop - first] if parts else np.empty(0, np.uint32)


@functools.cache
def _tokenizer(vocabulary: str) -> Tokenizer:
    return Tokenizer.from_file(vocabulary)


def _mark_after_letter(data: np.ndarray) -> np.ndarray:
    """Places of an ASCII mark behind an ASCII letter."""
    found = _MARK[data]
    found[1:] &= _LETTER[data[:-1]]
    found[:1] = False
    return found


class WordIds:
    """Ids of texts whose tokenizer lower-cases and never joins characters across white space.

    Nor does it join a letter and the mark behind it, so words are cut there too. Added tokens are
    words by themselves, as written; if the tokenizer has any that are looked for in the normalized
    text, take in neighbours or hold white space, all texts are encoded whole. Each distinct word
    goes through the tokenizers library once; the ids of at most ``limit`` words
    are remembered by the word's 64-bit hash. A hash stands for its word, so two words of one
    worker's memory that share it would share ids: at the limit the odds are under one in 10**8.
    """

    def __init__(self, vocabulary: str, limit: int = REMEMBERED):
        self.tokenizer, self.limit = _tokenizer(vocabulary), limit
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.whole = any(
            t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added
        )
        contents = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.added = re.compile(b"|".join(map(re.escape, contents))) if contents else None
        self.keys = np.empty(0, np.uint64)
        self.starts = np.empty(0, np.int64)
        self.counts = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        if len(self.keys) + len(keys) > self.limit:
            self.__init_memory()
        starts, counts, ids = [], [], []
        for i in range(0, len(words), 4096):
            found = self.tokenizer.encode(
                words[i : i + 4096], is_pretokenized=True, add_special_tokens=False
            )
            ids.append(np.array(found.ids, np.uint32))
            at = np.array(found.word_ids, np.int64)
            counts.append(np.bincount(at, minlength=min(4096, len(words) - i)))
        count = np.concatenate(counts)
        starts = len(self.ids) + np.cumsum(count) - count
        all_keys = np.concatenate([self.keys, keys])
        order = np.argsort(all_keys, kind="stable")
        self.keys = all_keys[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.counts = np.concatenate([self.counts, count])[order]
        self.ids = np.concatenate([self.ids, *ids])

    def __init_memory(self) -> None:
        self.keys, self.starts = self.keys[:0], self.starts[:0]
        self.counts, self.ids = self.counts[:0], self.ids[:0]

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """The spans of added tokens in the texts."""
        if self.added is None or not self.added.search(data):
            return []
        bounds = zip(offsets[:-1].tolist(), offsets[1:].tolist())
        return [found.span() for a, b in bounds for found in self.added.finditer(data, a, b)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and their number in each text."""
        if self.whole:
            found = [self.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts.to_pylist()]
            tokens = np.array([x for ids in found for x in ids], np.uint32)
            return tokens, np.array([len(ids) for ids in found], np.int64)
        data, offsets = text_bytes(texts)
        cut = _mark_after_letter(data)
        added = self._added(data, offsets)
        for start, end in added:
            cut[start] = True
            cut[start + 1 : end] = False
            cut[end : end + 1] = True
        cut[:1] = False
        words = words_of(data, offsets, lower=True, cut=cut)
        # Apart from words that differ in case only.
        words.hashes[np.searchsorted(words.starts, [start for start, _ in added])] ^= _ADDED
        distinct, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == distinct[known]
        if not known.all():
            if len(self.keys) + int((~known).sum()) > self.limit:
                self.__init_memory()
                known[:] = False
            new = first[~known]
            found = [
                data[a:b].tobytes().decode()
                for a, b in zip(words.starts[new].tolist(), words.ends[new].tolist())
            ]
            self._learn(distinct[~known], found)
            at = np.searchsorted(self.keys, distinct)
        word = at[which]
        counts = self.counts[word]
        ends = np.cumsum(counts)
        tokens = self.ids[
            np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[word] - ends + counts, counts)
        ]
        before = np.concatenate([[0], ends])
        return tokens, np.diff(before[words.bounds])


@functools.cache
def _word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def _with_end(tokens: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` after the tokens of each document."""
    return np.insert(tokens, np.cumsum(counts), np.uint32(end)), counts + 1


def write(
    docs: DataFrame,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    files: int | None = None,
) -> None:
    """Writes the ids of all texts as files, documents in ascending order of an integer id.

    Null and empty texts consist of the end id. Documents without an id come first; the files store
    them under the least 64-bit integer, which reads back as null. Repeated ids stand side by side,
    equal rows each with their own tokens; the order of different texts under one id is that of
    their bytes. An empty table gives files without documents. Further columns are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _word_ids(vocabulary)
        for batch in pieces(batches, size=SEGMENT_BYTES):
            tokens, counts = _with_end(*encoder.encode(batch.column("text")), end_id)
            segment = pack_segment(batch.column("id").to_numpy(), counts, tokens)
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.binary())], names=["value"])

    ids = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    rows = docs.select(ids.alias("id"), F.col(text).alias("text"))
    if files is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-size // FILE_BYTES))
    ordered = rows.repartitionByRange(files, "id").sortWithinPartitions("id", "text")
    (
        ordered.mapInArrow(run, "value binary")
        .select(F.col("value").cast("string").alias("value"))  # the writer copies the bytes as they are
        .write.option("lineSep", "\n")
        .option("compression", "none")
        .text(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, tokens): each document of the files with its ids and the ids before it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                done = 0
                for ids, counts, tokens in segments(memoryview(content.as_buffer())):
                    ends = done + np.cumsum(counts.astype(np.int64))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * len(ids)),
                            pa.array(ids),
                            pa.array(ends - counts),
                            binaries(tokens.astype("<u4"), counts.astype(np.int64)).cast(pa.binary()),
                        ],
                        names=["path", "id", "start", "tokens"],
                    )
                    done = int(ends[-1]) if len(ends) else done

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = files.select("path", "content").mapInArrow(
        run, "path string, id long, start long, tokens binary"
    )

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                first, size = _extent(memoryview(content.as_buffer()))
                if first is not None:
                    yield pa.RecordBatch.from_pydict({"path": [name], "first": [first], "size": [size]})

    # One row a file, as in the list of files that the driver holds to plan this read; no id is in
    # two files.
    sizes = files.select("path", "content").mapInArrow(heads, "path string, first long, size long")
    ordered = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("path", F.coalesce(F.sum("size").over(ordered), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "path").select(
        F.nullif("id", F.lit(NO_ID)).alias("id"),
        (F.col("before") + F.col("start")).alias("start"),
        "tokens",
    )
