"""Files read back against the tokenizers library on whole texts."""

import numpy as np
import pytest

from rillhouse.llm import token_files as T

TEXTS = [
    (5, "Plain words, and marks!! it's we'll a-b 1234 x"),
    (1, None),
    (2, ""),
    (9, "ÉÀ ΣΑΣ ς İstanbul ́a é   日本語. \t\n\x1c ﬁ don't<|endoftext|>"),
    (3, "long " * 40_000),
    (7, "z" * 5_000 + " ###$$$ word###"),
    (9, "tie"),
    (9, "tie"),
    (None, "no id"),
]


def expected(text):
    return [*T._tokenizer(T.VOCABULARY).encode(text or "", add_special_tokens=False).ids, T.END_ID]


@pytest.mark.parametrize("files", [1, 3, None])
def test_round_trip(spark, tmp_path, files):
    docs = spark.createDataFrame(
        [(i, t, "x", 0) for i, t in TEXTS], "doc_id long, text string, value string, start int"
    )
    T.write(docs, str(tmp_path / "out"), files=files)
    rows = sorted(T.read(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == [None, 1, 2, 3, 5, 7, 9, 9, 9]
    texts = {}
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0], (x[1] or "").encode())):
        texts.setdefault(i, []).append(t)
    start = 0
    for row in rows:
        ids = np.frombuffer(row.tokens, "<u4").tolist()
        assert ids == expected(texts[row.id].pop(0))
        assert row.start == start
        start += len(ids)


def test_empty_table(spark, tmp_path):
    T.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "out"))
    assert T.read(spark, str(tmp_path / "out")).collect() == []


@pytest.mark.parametrize("high", [1, 2, 1000, 1 << 20, 1 << 32])
def test_blocks(high):
    rng = np.random.default_rng(1)
    values = rng.integers(0, high, 3000).astype(np.uint32)
    values[::97] = np.uint32((1 << 32) - 1)
    segment = memoryview(T.pack_segment(np.array([4, 5]), np.array([1000, 2000]), values))
    ((ids, counts, found),) = T.segments(segment)
    assert found.tolist() == values.tolist()
    assert ids.tolist() == [4, 5] and counts.tolist() == [1000, 2000]
    assert T.tokens_at(segment, 1020, 2050).tolist() == values[1020:2050].tolist()


def test_memory_of_words_is_bounded():
    import pyarrow as pa

    encoder = T.WordIds(T.VOCABULARY, limit=50)
    for i in range(20):
        texts = [f"word{i} w{i * j} and, more" for j in range(30)]
        tokens, counts = encoder.encode(pa.array(texts))
        assert tokens.tolist() == [x for t in texts for x in expected(t)[:-1]]
        assert counts.sum() == len(tokens)


ADDED = [
    "a <|endoftext|> b",
    "<|endoftext|>",
    "word<|endoftext|>'s and<|startoftext|><|endoftext|>!! x",
    "<|ENDOFTEXT|> <|endoftext|> <|EndOfText|>\n<|startoftext|>\n",
    "cut off here <|endof",  # no token spans two texts
    "text|> and on",
    None,
    "",
    "e<|endoftext|>́ <<|endoftext|>> <|endoftext |> İ<|endoftext|>Σ",
    "<|endoftext|>" * 300,
]


@pytest.mark.parametrize("limit", [3, T.REMEMBERED])
def test_added_tokens_as_the_library_has_them(limit):
    import pyarrow as pa
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(T.VOCABULARY)
    encoder = T.WordIds(T.VOCABULARY, limit=limit)
    for texts in (ADDED, ADDED[::-1], ["plain"], []):
        ids = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
        tokens, counts = encoder.encode(pa.array(texts, pa.string()))
        assert tokens.tolist() == [x for some in ids for x in some]
        assert counts.tolist() == [len(some) for some in ids]
    assert fresh.encode("a <|endoftext|> b", add_special_tokens=False).ids == [320, 49407, 321]


@pytest.mark.parametrize("kind", [{"normalized": True}, {"lstrip": True}, {"single_word": True}, {}])
def test_other_added_tokens(tmp_path, kind):
    import pyarrow as pa
    from tokenizers import AddedToken, Tokenizer

    fresh = Tokenizer.from_file(T.VOCABULARY)
    fresh.add_tokens([AddedToken("[PAD1]", **({"normalized": False} | kind))])
    path = str(tmp_path / "other.json")
    fresh.save(path)
    texts = ["a  [PAD1] b[PAD1]c [pad1] [Pad1]", "[pad1] [PAD1]", None, "[pad1]<|endoftext|>"]
    encoder = T.WordIds(path)
    assert encoder.whole == bool(kind)
    ids = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    tokens, counts = encoder.encode(pa.array(texts))
    assert tokens.tolist() == [x for some in ids for x in some]
    assert counts.tolist() == [len(some) for some in ids]


def test_files_with_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(T.VOCABULARY)
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string")
    T.write(docs, str(tmp_path / "out"), files=2)
    start = 0
    for row in sorted(T.read(spark, str(tmp_path / "out")).collect(), key=lambda r: r.start):
        ids = np.frombuffer(row.tokens, "<u4").tolist()
        assert ids == [*fresh.encode(ADDED[row.id] or "", add_special_tokens=False).ids, T.END_ID]
        assert row.start == start
        start += len(ids)
    assert start > 300
