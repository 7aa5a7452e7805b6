"""The join against brute force over all pairs, with low limits so that all branches run."""

import random
import re

import numpy as np
import pytest

from rillhouse.llm import components as C
from rillhouse.llm import ngram_join as J
from rillhouse.llm import sieve


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def plain(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 75 * len(x | y):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted(str((i, len(x), None if i is None else find(i))) for i, x in sets)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = text(40)
    texts = []
    for _ in range(25):
        base = text(rng.choice([1, 3, 5, 6, 9, 14, 18, 40, 120, 400]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy[len(copy) // 2 : len(copy) // 2] = passage[: rng.choice([10, 40])]
            texts.append(rng.choice([" ", "\n", " \t"]).join(copy))
    texts += [" ".join(passage + text(rng.randint(0, 12))) for _ in range(30)]
    texts += ["", None, "a b", "A  B", "a b c", "É b c d e f", "é b c d e f"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[0], (None, texts[0]), (rows[1][0], texts[3]), (7000, texts[-40])]


@pytest.mark.parametrize(("seed", "least"), [(1, 64), (2, 1)])
def test_against_all_pairs(spark, monkeypatch, seed, least):
    monkeypatch.setattr(J, "LEAST", least)
    if least == 1:
        monkeypatch.setattr(J, "SIGMAS", 0.0)
        monkeypatch.setattr(J, "PARTNERS", 3)
        monkeypatch.setattr(J, "BLOCK", 2)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    found = J.near_duplicates(docs).collect()
    assert sorted(str(tuple(r)) for r in found) == plain(rows)


def near_group(seed):
    """Many copies of one text, with few to many changes that recur among them."""
    rng = random.Random(seed)
    vocabulary = [f"u{i}" for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(140)]
    swaps = [(rng.randrange(140), rng.choice(vocabulary)) for _ in range(60)]
    texts = []
    for _ in range(260):
        copy = list(base)
        for at, word in rng.sample(swaps, rng.choice([1, 2, 4, 6, 8, 9, 10])):
            copy[at] = word
        texts.append(copy)
    # A chain: each is like the next one only.
    texts += [base[:20] + texts[0][5 * k : 5 * k + 90] for k in range(8)]
    return [(i, " ".join(words)) for i, words in enumerate(texts)]


@pytest.mark.parametrize("block", [1024, 16])
def test_near_group_with_recurring_changes(spark, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = near_group(6)
    read = []
    verified = J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, texts: read.append(pairs.count()) or verified(pairs, texts))
    found = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(tuple(r)) for r in found) == plain(rows)
    assert len({r.component_id for r in found}) > 20
    assert sum(read) < len(rows) * (len(rows) - 1) // 2 // 5


def test_bitmaps_bound_the_difference(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, "id long, text string")
    found = docs.mapInArrow(J._parities, "id long, bits binary").where("id is not null and id < 7000").collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(shingles(t))
    bits = {r.id: np.frombuffer(r.bits, np.uint64) for r in found if len(texts[r.id]) == 1}
    ids = sorted(bits)
    some = np.stack([bits[i] for i in ids])
    least = J.differences(some, some)
    real = np.array([[len(texts[i][0] ^ texts[j][0]) for j in ids] for i in ids])
    assert (least <= real).all() and (least[real > 0] > 0).mean() > 0.99 and (least == real).mean() > 0.2


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_partners_share_a_key():
    """Whatever the classes, sets at or above the similarity have an index key in common."""
    rng = np.random.default_rng(5)
    universe = rng.integers(0, 1 << 62, 3000).astype(np.uint64)
    class_of = dict(zip(universe.tolist(), rng.choice([0, 0, 1, 2], len(universe)).tolist()))
    tested = 0
    for _ in range(600):
        n = int(rng.choice([2, 4, 8, 11, 12, 13, 15, 16, 17, 30, 100, 300]))
        x = rng.choice(universe, n, replace=False)
        y = x[: n - int(rng.integers(0, n // 4 + 1))]
        y = np.unique(np.concatenate([y, rng.choice(universe, int(rng.integers(0, n // 4 + 1)))]))
        x = np.sort(x)
        both = len(np.intersect1d(x, y))
        if 100 * both < 75 * (len(x) + len(y) - both):
            continue
        for pick in (lambda t: 0, class_of.get, lambda t: 3):
            classes = [np.array([pick(t) for t in s.tolist()]) for s in (x, y)]
            keys = [np.concatenate(J.index_keys(s, c, True)[:2]) for s, c in zip((x, y), classes)]
            assert len(np.intersect1d(*keys)), (len(x), len(y), both)
            keys = [np.concatenate(J.index_keys(s, c)[:2]) for s, c in zip((x, y), classes)]
            shared = np.intersect1d(*keys)
            assert len(shared), (len(x), len(y), both)
            alone = [J.index_keys(s, c)[2] for s, c in zip((x, y), classes)]
            if all(alone):
                assert len(shared) >= min(J.fewest(np.array([len(x), len(y)])))
        tested += 1
    assert tested > 200


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = C.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {i: find(i) for i in range(1000) if find(i) != i}


def test_sieve_keeps_all_that_are_in_it(spark):
    ids = spark.range(0, 5000, 7)
    rows = spark.range(10_000).selectExpr("if(id = 9999, null, id) as id", "'x' as text")
    kept = {r.id for r in sieve.sifted(rows, "id", sieve.sieve(ids, "id", 1 << 16)).collect()}
    assert {r.id for r in ids.collect()} <= kept and len(kept) < 1000 and None not in kept


def repeated_ids(seed):
    """Near pairs whose texts share their ids with other texts, of equal or of different size."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = []
    for pair in range(60):
        n = rng.choice([14, 18, 40, 120])
        base = text(n)
        copy = list(base)
        copy[rng.randrange(n)] = rng.choice(vocabulary)
        passage = base[: n // 3]
        rows += [(2 * pair, base), (2 * pair + 1, copy)]
        for i in (2 * pair, 2 * pair + 1):
            size = rng.choice([n, n, 3 * n, 400])
            # Some hold a passage of the pair, so that they meet under its keys as well.
            other = text(size) if rng.random() < 0.4 else passage + text(size - len(passage))
            rows += [(i, other)] * rng.choice([0, 1, 1, 2])
            if rng.random() < 0.3:
                rows += [(500 + rng.randrange(40), other[:-1]), (i, [])]
    rng.shuffle(rows)
    return [(i, " ".join(words)) for i, words in rows]


@pytest.mark.parametrize(("seed", "least"), [(3, 64), (4, 1)])
def test_ids_with_several_texts(spark, monkeypatch, seed, least):
    if least == 1:
        monkeypatch.setattr(J, "LEAST", least)
        monkeypatch.setattr(J, "SIGMAS", 0.0)
        monkeypatch.setattr(J, "PARTNERS", 3)
    rows = repeated_ids(seed) + [(None, "a b c d e f g"), (None, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = J.near_duplicates(docs).collect()
    assert sorted(str(tuple(r)) for r in found) == plain(rows)


def test_one_of_each_keeps_one_python_worker_a_task(spark):
    text = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"term{i}" for i in range(40))
    rows = [(3, text, "c"), (1, text + " more", "a"), (5, other, "z"), (5, other, "b"), (1, text, "b"), (None, text, "n"),
            (None, text, "n"), (8, "", "e"), (8, None, "e"), (9, None, "x"), (7, other + " end", "y"), (7, other, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = J.keep_one(docs)
    key = lambda row: tuple((x is not None, x) for x in row)
    assert sorted(map(tuple, kept.collect()), key=key) == sorted(
        [(None, text, "n"), (None, text, "n"), (1, text, "b"), (5, other, "b"), (8, None, "e"), (9, None, "x")], key=key
    )
    assert kept.columns == docs.columns and kept.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    above = []
    for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [x for x in above if x[0] < depth] + [(depth, "MapInArrow" in line)]
        assert sum(x[1] for x in above) < 2, line
