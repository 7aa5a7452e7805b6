"""The pipeline against its stages' brute-force versions on a small corpus."""

import random

import numpy as np

import corpus_pipeline
from rillhouse.llm import byte_bpe

SYLLABLES = {"aa": "the ing on er th and", "bb": "ción que ó ll ñ ado", "cc": "ß ung ä sch keit der"}
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(tmp_path, spark):
    rng = random.Random(11)

    def words(lang, n):
        parts = SYLLABLES[lang].split()
        return ["".join(rng.choice(parts) for _ in range(rng.randint(2, 5))) for _ in range(n)]

    texts, kinds = [], {}
    items = {i: " ".join(words("aa", 25)) for i in range(5)}
    for i in range(240):
        lang = list(SYLLABLES)[i % 3]
        text = words(lang, rng.choice([30, 80, 300]))
        kind = {0: "copy", 1: "leak", 2: "secret", 3: "junk"}.get(i % 12, "clean")
        if kind == "copy" and i >= 12:
            text = texts[i - 12][1].split(" ")
            text[len(text) // 2] = "changed"
        if kind == "leak":
            text[5:5] = items[i % 5].split(" ")
        if kind == "secret":
            text[7:7] = ["password=" + "x7Q" * 5]
        texts.append((i, "12345 67890 !!" if kind == "junk" else " ".join(text), lang))
        kinds[i] = kind
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in texts]
    rows += [(1000, None, "aa", "s", 0), (1001, "", "bb", "s", 0), (4, texts[4][1], "bb", "t", len(texts[4][1]))]
    rows += [(None, " ".join(words("cc", 60)), None, "s", None)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    tests = spark.createDataFrame(list(items.items()), "item_id long, text string")
    tests.write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, kinds


def test_stages(spark, tmp_path):
    rows, kinds = corpus(tmp_path, spark)
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in found]
    assert len(ids) == len(set(ids))
    by_id = {r.doc_id: r for r in found}
    assert {i for i, k in kinds.items() if k in ("clean", "secret")} <= set(ids)
    assert set(ids) - {None} <= {i for i, k in kinds.items() if k in ("clean", "secret")} | {0}
    assert 0 in ids and None in ids
    encode = byte_bpe.tokenizer(byte_bpe.VOCABULARY).encode_ordinary
    for i, text, *_ in rows:
        if i in by_id and kinds.get(i) in ("clean", "secret"):
            text = text.replace("password=" + "x7Q" * 5, "[secret]")
            assert np.frombuffer(by_id[i].ids, "<u4").tolist() == encode(text)
            assert by_id[i].n_tokens == len(encode(text))


def test_each_stage_keeps_the_columns(spark, tmp_path):
    rows, _ = corpus(tmp_path, spark)
    docs = spark.createDataFrame([(*r, "more") for r in rows], COLUMNS + ", b string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "b"]
        docs = spark.createDataFrame(docs.collect(), COLUMNS + ", b string")
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    empty = spark.createDataFrame([], "item_id long, text string")
    empty.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
