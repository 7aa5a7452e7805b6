"""Phrases against plain counting, with low limits so that all branches run."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from rillhouse.llm import collocations as C

A_TO_Z = {c: c + 32 for c in range(65, 91)}


def plain(rows, least, top):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        found = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for k in range(1, 6):
                found.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        often = {p: a for p, a in found.items() if a >= least}
        best = []
        for p, a in often.items():
            if len(p) < 2:
                continue
            inside = any(
                len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in often.items()
            )
            if inside:
                continue
            cuts = [(1000 * a * sizes[lang] // (often[p[:k]] * often[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(p).encode(), a, often[p[:k]], often[p[k:]], score))
        for rank, (_, _, phrase, a, l, r, score) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, l, r, sizes[lang], score))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "The", "the", "a b", "x-y", "ﬁ"]
    fixed = ["one two three four five six", "red, green blue", "the w1 w2"]
    rows = []
    for _ in range(150):
        words = []
        for _ in range(rng.choice([0, 3, 20, 60])):
            words.append(rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary[: rng.choice([4, 46])]))
            words.append(rng.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r", "?!"]))
        rows.append((rng.choice(["en", "en", "fr", None, "und"]), "".join(words)))
    return rows + [("en", None), ("en", ""), ("de", "..."), ("xx", "w1 w2"), rows[0], rows[0]]


def mined(spark, rows, **limits):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, a long, phrase string")
    got = C.mine(docs.repartition(3), **limits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("numbered", [C.NUMBERED, 60, 9, 0])
def test_against_plain_counting(spark, numbered):
    """Few numbers: more and more phrases are counted by their text."""
    rows = corpus(1)
    assert mined(spark, rows, least=6, top=50, numbered=numbered) == plain(rows, 6, 50)


def test_dense_tiles(spark, monkeypatch):
    monkeypatch.setattr(C, "DENSE", 3)
    monkeypatch.setattr(C, "PAIRS", 40)
    monkeypatch.setattr(C, "KEPT_TILES", 2)
    rng = np.random.default_rng(3)
    tiles = C.Tiles()
    place, one, two = rng.integers(0, 3, 5000), rng.zipf(1.3, 5000) % 2000, rng.zipf(1.3, 5000) % (1 << C.NUMBER_BITS)
    rows = []
    for p in range(3):
        its = np.flatnonzero(place == p)
        for i in range(0, len(its), 37):
            some = its[i : i + 37]
            rows += [r for b in tiles.add(p, one[some], two[some]) for r in b.to_pylist()]
    rows += [r for b in tiles.rest() for r in b.to_pylist()]
    got = Counter()
    for r in rows:
        got[r["pair"]] += r["n"]
    pairs = (place << 2 * C.NUMBER_BITS | one << C.NUMBER_BITS | two).tolist()
    assert got == Counter(pairs)


def test_scores_beyond_64_bits(spark):
    big = 400_000_000_000_000
    found = [("en", 1, "x", big), ("en", 1, "y", big - 7), ("en", 2, "x y", big - 9)]
    found = spark.createDataFrame(found, "lang string, words int, phrase string, a long")
    sizes = spark.createDataFrame([("en", 900 * big)], "lang string, n long")
    row = C.scored(found, sizes).first()
    assert row.score == 1000 * (big - 9) * 900 * big // (big * (big - 7))


def test_a_long_text(spark):
    rows = [("en", "aa bb cc " * 300_000)]
    assert mined(spark, rows, least=100, top=9) == plain(rows, 100, 9)


def test_empty_table(spark):
    assert mined(spark, []) == []
    assert mined(spark, [("en", None)]) == []
