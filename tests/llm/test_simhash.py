"""Fingerprints, trees and components against plain loops."""

import random
import re

import numpy as np
import pytest
import xxhash

from rillhouse.llm import simhash as S


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain(rows, radius=2):
    marks = [plain_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(str((k, f"{m:016x}", least.get(find(i)))) for i, ((k, _), m) in enumerate(zip(rows, marks)))


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "ABC", "abc"]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 4, 60, 300, 2000]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n\t", "  "]).join(copy))
    texts += ["", None, " \t\n", "a b", "A B", "a b c"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[0], (None, rows[3][1]), (rows[1][0], rows[2][1]), (None, "nobody else has this text")]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 64)
    for _, text in corpus(1):
        assert S.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('the ß text') as h").first().h % 2**64 == xxhash.xxh64_intdigest("the ß text".encode(), 42)


@pytest.mark.parametrize("hot", [S.HOT, 1])
def test_against_all_pairs(spark, hot):
    rows = corpus(2)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, fp string, least long")
    got = S.near_duplicates(docs, hot=hot)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(rows)


def near_values(rng, n):
    """Distinct values in groups within few bits of each other."""
    values = set()
    while len(values) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 30])):
            value = base
            for _ in range(rng.randrange(5)):
                value ^= 1 << rng.randrange(64)
            values.add(value)
    return np.array(sorted(values), np.uint64)


def test_tree():
    values = near_values(random.Random(5), 700)
    tree = S.Tree(values)
    assert sorted(tree.values.tolist()) == values.tolist()
    for radius in (0, 2, 7):
        query, node = tree.within(values, radius)
        got = sorted(zip(values[query].tolist(), tree.values[node].tolist()))
        assert got == sorted((int(a), int(b)) for a in values for b in values if int(a ^ b).bit_count() <= radius)


@pytest.mark.parametrize("hot", [S.HOT, 10, 1])
def test_links_keep_all_components(spark, hot):
    rng = random.Random(6)
    values = near_values(rng, 400)
    # A large group: one centre with single bits and pairs of bits changed.
    centre = rng.getrandbits(64)
    more = [centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(i, 64, 5)]
    values = np.unique(np.concatenate([values, np.array(more, np.uint64)]))
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    label = {int(v): int(v) for v in values}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    def groups():
        found = {}
        for v in label:
            found.setdefault(find(v), set()).add(v)
        return sorted(map(sorted, found.values()))

    for r in S.links(rows, hot).collect():
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() <= 4096
        label[find(a)] = find(b)
    got, label = groups(), {int(v): int(v) for v in values}
    for i, a in enumerate(values):
        for b in values[:i][np.bitwise_count(values[:i] ^ a) <= 2]:
            label[find(int(a))] = find(int(b))
    assert got == groups()


def test_empty_table(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
