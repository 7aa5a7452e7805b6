"""Encoding against the library on whole texts, and exact round trips."""

import numpy as np
import pytest

from rillhouse.llm import byte_bpe

WORDS = "The quick  brown fox's\n\n\n  tail, 12345 — naïve 日本語 \t x" * 9
TEXTS = {
    1: "short",
    2: "",
    3: None,
    4: WORDS,
    5: "a" * 700,
    6: " " * 700,
    7: "x " * 300,
    8: "\n \n" * 200 + "end's" + "!" * 90,
    9: "it's we'll\x1c\x1d they've" * 30,
    10: "ab" * 100 + WORDS + "z" * 130 + WORDS,
    11: WORDS,
}


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 32), (100, 20), (50, 50), (1 << 16, 1 << 11)])
def test_encode_decode(spark, chunk, overlap):
    rows = [*TEXTS.items(), (4, WORDS), (None, WORDS)]
    docs = spark.createDataFrame(
        [(k, v, "clash", 1) for k, v in rows], "doc_id long, text string, ids string, piece int"
    )
    encoded = byte_bpe.encode(docs, chunk=chunk, overlap=overlap)
    found = byte_bpe.decode(encoded).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(k) for k, _ in rows)
    encode = byte_bpe.tokenizer(byte_bpe.VOCABULARY).encode_ordinary
    for row in found:
        text = (WORDS if row.doc_id is None else TEXTS[row.doc_id]) or ""
        assert np.frombuffer(row.ids, "<u4").tolist() == encode(text), row.doc_id
        assert bytes(row.bytes).decode() == text


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.decode(byte_bpe.encode(docs)).collect() == []


def test_boundaries_follow_no_space():
    text = "a  b\n\nc's d"
    assert all(not text[x - 1].isspace() for x in byte_bpe.boundaries(text))
