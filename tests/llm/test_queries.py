"""Every registered query over the whole smallest tables: its SQL, or an independent computation of its columns."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from rillhouse.llm import byte_bpe
from rillhouse.llm import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels pages"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'").fetchall()


def documents():
    columns = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    return {doc_id: (text, lang) for doc_id, text, lang in columns}


def answer(spark, name):
    """The rows of a query by document."""
    df = Q.queries()[name](spark, SF)
    rows = df.collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(found) and set(found) == set(documents())
    return found


def crc(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = con.execute(Q.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = Q.queries()[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*names).collect())))
    assert got == sorted(map(str, cursor.fetchall()))
    if name != "op12_collocations":  # no phrase is that frequent in the smallest table
        assert got


def test_language_id(spark):
    texts = documents()
    right = []
    for doc_id, r in answer(spark, "op2_language_id").items():
        text, lang = texts[doc_id]
        assert r.held_out == (crc(doc_id, 4) == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        if r.held_out and lang and r.lang_pred != "und":
            right.append(r.lang_pred == lang)
    assert np.mean(right) > 0.8


def test_token_files(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found, start = answer(spark, "op3_token_files"), 0
    for doc_id, (text, _) in sorted(documents().items()):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        r = found[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_toxicity(spark):
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    found = answer(spark, "op4_toxicity")
    for doc_id, r in found.items():
        assert r.held_out == (crc(doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    told = [found[i].predicted == label for i, label in toxic.items() if i in found and found[i].held_out]
    assert np.mean(told) > 0.8


def test_quality_rules(spark):
    texts = documents()
    for doc_id, r in answer(spark, "op6_quality_rules").items():
        text = texts[doc_id][0] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        lines, earlier, again = text.split("\n"), set(), 0
        for one in lines:
            again += bool(WORD.search(one)) and one in earlier
            earlier.add(one)
        counts = (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(repeated))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r.base_failed and r.kept)


def test_byte_bpe(spark):
    encode = byte_bpe.tokenizer(byte_bpe.VOCABULARY).encode_ordinary
    texts = documents()
    for doc_id, r in answer(spark, "op7_byte_bpe").items():
        text = texts[doc_id][0] or ""
        ids = encode(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_secret_scan(spark):
    assign = re.compile(
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    )
    kinds = {"assign": (assign, 2, 8), "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 16), "hex": (re.compile(r"[0-9a-f]+"), 0, 32)}
    texts = documents()
    for doc_id, r in answer(spark, "op9_secret_scan").items():
        text, spans = texts[doc_id][0] or "", []
        for place, (kind, (pattern, group, least)) in enumerate(kinds.items()):
            found = [m for m in pattern.finditer(text) if len(m[group]) >= least]
            assert getattr(r, f"n_{kind}") == len(found)
            spans += [(m.start(), place, f"{kind}:{m.start()}:{m.end()}") for m in found]
        base = [s for *_, s in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | ({""} if not base else set())


def test_decontaminate(spark):
    items = dict(duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall())
    texts = documents()
    found = Q.queries()["op10_decontaminate"](spark, SF).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    for doc_id, (text, _) in texts.items():
        for item_id, item in items.items():
            if text and item and len(item.split()) >= 20 and item in text:
                assert (doc_id, item_id) in pairs
    assert {d for d, _ in pairs} <= set(texts) and {i for _, i in pairs} <= set(items)


def test_simhash(spark):
    marks = {}
    for doc_id, (text, _) in documents().items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = np.array([xxhash.xxh64_intdigest(g.encode(), 42) for g in grams], np.uint64)
        ones = [int((hashes >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]
        marks[doc_id] = sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))
    least = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for a in marks:
            for b in marks:
                if least[b] < least[a] and (marks[a] ^ marks[b]).bit_count() <= 2:
                    least[a], changed = least[b], True
    found = answer(spark, "op13_simhash")
    assert {i: (r.fingerprint, r.component_id) for i, r in found.items()} == {i: (f"{marks[i]:016x}", least[i]) for i in marks}
