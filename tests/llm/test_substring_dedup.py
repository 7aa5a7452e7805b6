"""Removal of repeated windows against plain loops, with small windows and shards."""

import random
import re

import pytest

from rillhouse.llm import substring_dedup as S
from rillhouse.llm.automaton import SuffixAutomaton


def plain(rows, window):
    found = []
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - window + 1):
                at = tuple(w[k : k + window])
                first[at] = min(first.get(at, i), i)
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        found.append(str((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(found)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "Ä", "the", "x1", "日本"]) + str(rng.randrange(40))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(n) for n in (10, 12, 13, 25, 60, 200)]
    texts = []
    for _ in range(60):
        parts = text(rng.choice([0, 1, 7, 30]))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randrange(max(len(p) - 14, 1))
            parts += p[a : a + rng.choice([9, 13, 14, 40, 300])] + text(rng.choice([0, 1, 9]))
        texts.append(rng.choice([" ", "\n", " \t"]).join(parts))
    texts += ["same " * 400, "same " * 90, "x same " * 50 + "same " * 60, "", None, " \n", "one", "  a"]
    texts += [texts[3], texts[5], texts[3]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[0], (None, texts[3]), (rows[4][0], texts[5]), (-5, texts[7])]


@pytest.mark.parametrize(("window", "anchor", "shard", "least"), [(12, 4, 256, 32), (12, 4, 2, 1), (50, 8, 3, 1)])
def test_against_plain(spark, monkeypatch, window, anchor, shard, least):
    monkeypatch.setattr(S, "LEAST", least)
    rows = corpus(window + shard)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, start string").repartition(3)
    found = S.remove_repeats(docs, window=window, anchor=anchor, shard=shard).collect()
    assert sorted(str(tuple(r)) for r in found) == plain(rows, window)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton():
    rng = random.Random(1)
    texts = [[rng.randrange(3) for _ in range(rng.randint(0, 30))] for _ in range(12)]
    automaton = SuffixAutomaton()
    for owner, t in enumerate(texts):
        automaton.add(t, owner)
    automaton.finish()
    for _ in range(50):
        probe = [rng.randrange(3) for _ in range(20)]
        for size in (1, 3, 5):
            expected = {}
            for end in range(size, len(probe) + 1):
                part = probe[end - size : end]
                owners = [o for o, t in enumerate(texts) if any(t[k : k + size] == part for k in range(len(t)))]
                if owners:
                    expected[end] = owners[0]
            assert dict(automaton.matches(probe, size)) == expected
