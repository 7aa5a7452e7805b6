"""Byte-level BPE encoding and decoding, long texts in overlapping chunks.

A text of at most ``chunk`` characters is encoded by itself. A longer one is cut into chunks that
overlap; the chunks are pre-tokenised in parallel, each from its own start. Where the pre-token
boundaries of two neighbours agree inside their overlap the parses have met again, and from there on
they are the same; the text is cut at the first such place, and the pieces between cuts are encoded
in parallel. Neighbours that do not meet (one run of letters longer than the overlap) become one
piece. Only places after a character other than white space count, since the pattern looks ahead
only at the end of white space: a piece by itself then parses as it does inside the text.

Null and empty texts have no ids and decode to no bytes; repeated rows, null ids and equal ids each
keep their row. Only the two named columns are read, so further columns of the input may have any name.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillhouse.llm.arrow import binaries, pieces

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Characters of a chunk and of its overlap with the next one.
CHUNK = 1 << 16
OVERLAP = 1 << 11


@functools.cache
def tokenizer(vocabulary: str) -> tiktoken.Encoding:
    """The encoder of a rank file, once per process."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


def _encoded(vocabulary: str, texts: pa.Array) -> pa.Array:
    encode = tokenizer(vocabulary).encode_ordinary
    ids = [np.array(encode(text), "<u4") if text else np.empty(0, "<u4") for text in texts.to_pylist()]
    flat = np.concatenate(ids) if ids else np.empty(0, "<u4")
    return binaries(flat, np.array([len(x) for x in ids], np.int64))


def _encode_texts(docs: DataFrame, kind: str, vocabulary: str) -> DataFrame:
    """``text`` of each row replaced by ``ids``; ``kind`` is the type of the other columns."""
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids = _encoded(vocabulary, batch.column("text")).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), ids], names=[*keep, "ids"]
            )

    return docs.select(*keep, "text").mapInArrow(run, f"{kind}, ids binary")


def _cut(chunk: int, overlap: int):
    """Chunks of each text, numbered, with the first ``overlap`` characters of the next chunk."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for i in range(0, len(text), chunk):
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": pa.array([key]),
                            "i": pa.array([i // chunk], pa.int64()),
                            "text": pa.array([text[i : i + chunk + overlap]]),
                        }
                    )

    return run


def boundaries(text: str) -> list[int]:
    """Starts of the pre-tokens that do not follow white space, the last pre-token's included."""
    found = [m.start() for m in regex.finditer(public_tokenizers.PATTERN, text)]
    return [x for x in found if x and not text[x - 1].isspace()]


def _meeting_places(chunk: int, overlap: int):
    """Boundaries of each chunk in its first ``overlap`` characters and in those after its end."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            head, tail = [], []
            for i, text in zip(batch.column("i").to_pylist(), batch.column("text").to_pylist()):
                found, at = boundaries(text), i * chunk
                head.append([at, *(at + x for x in found if x < overlap)])
                tail.append([at + x for x in found if x >= chunk])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("i"), pa.array(head, kind), pa.array(tail, kind)],
                names=["key", "i", "head", "tail"],
            )

    return run


def _joined(parts: Column) -> Column:
    """The binary values of sorted (number, value) structs, one after another."""
    return F.unhex(F.array_join(F.transform(F.array_sort(parts), lambda x: F.hex(x["value"])), ""))


def _encode_long(texts: DataFrame, vocabulary: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) of distinct (key, text) rows with texts longer than ``chunk``."""
    chunks = texts.mapInArrow(_cut(chunk, overlap), "key string, i long, text string")
    chunks = chunks.repartition("key", "i")
    places = chunks.mapInArrow(
        _meeting_places(chunk, overlap), "key string, i long, head array<long>, tail array<long>"
    )
    by_text = Window.partitionBy("key").orderBy("i")
    cuts = (
        places.withColumn("end", F.array_min(F.array_intersect("tail", F.lead("head").over(by_text))))
        .withColumn("start", F.lag("end").over(by_text))
        .withColumn("last", F.lead("i").over(by_text).isNull())
        .withColumn("piece", F.count("start").over(by_text))
        .select("key", "i", "start", "end", "last", "piece")
    )
    at = F.col("i") * F.lit(chunk)
    skip = F.coalesce(F.col("start") - at, F.lit(0))
    stop = F.when(F.col("last"), F.char_length("text")).otherwise(
        F.coalesce(F.col("end") - at, F.lit(chunk))
    )
    parts = chunks.join(cuts, ["key", "i"]).select(
        "key",
        "piece",
        "i",
        F.substring("text", (skip + 1).cast("int"), (stop - skip).cast("int")).alias("text"),
    )
    whole = (
        parts.groupBy("key", "piece")
        .agg(F.array_sort(F.collect_list(F.struct("i", "text"))).alias("parts"))
        .select("key", "piece", F.array_join(F.col("parts")["text"], "").alias("text"))
    )
    encoded = _encode_texts(whole, "key string, piece long", vocabulary)
    ids = F.collect_list(F.struct("piece", F.col("ids").alias("value")))
    return encoded.groupBy("key").agg(_joined(ids).alias("ids"))


def encode(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(key, ids): the token ids of each text as little-endian unsigned 32-bit integers.

    Equal long texts are encoded once. See the module for null, empty and repeated rows.
    """
    docs = docs.select(F.col(key).alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    kind = f"id {docs.schema['id'].dataType.simpleString()}"
    is_long = F.char_length("text") > chunk
    short = _encode_texts(docs.where(~is_long), kind, vocabulary)
    long = docs.where(is_long).withColumn("key", F.sha2("text", 256))
    texts = long.groupBy("key").agg(F.first("text").alias("text"))
    ids = _encode_long(texts, vocabulary, chunk, overlap)
    rows = long.select("id", "key").join(ids, "key").select("id", "ids")
    return short.unionByName(rows).select(F.col("id").alias(key), "ids")


def decode(
    encoded: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY
) -> DataFrame:
    """(key, ids, bytes): each row's ids and the bytes of its tokens, one after another."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = tokenizer(vocabulary).decode_bytes
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                found = [step(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("ids"), pa.array(found, pa.binary())],
                    names=["id", "ids", "bytes"],
                )

    encoded = encoded.select(F.col(key).alias("id"), F.col(ids).alias("ids"))
    kind = encoded.schema["id"].dataType.simpleString()
    decoded = encoded.mapInArrow(run, f"id {kind}, ids binary, bytes binary")
    return decoded.select(F.col("id").alias(key), "ids", "bytes")
