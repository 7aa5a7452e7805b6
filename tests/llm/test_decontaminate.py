"""Planted copies, exact and edited, and the alignment against a plain table."""

import random

import numpy as np

from rillhouse.llm import decontaminate as D


def plain(item, passage):
    rows = [[0.0] * (len(passage) + 1)]
    best = 0.0
    for x in item:
        row = [0.0]
        for j, y in enumerate(passage):
            step = rows[-1][j] + (1.0 if x == y else -D.PENALTY)
            row.append(max(0.0, step, rows[-1][j + 1] - D.PENALTY, row[-1] - D.PENALTY))
        rows.append(row)
        best = max(best, *row)
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 20))
        score, start, end = D.align(a, b)
        assert abs(score - plain(a, b)) < 1e-9
        if score > 0:
            assert 0 <= start < end <= len(b)
            assert abs(plain(a, b[start:end]) - score) < 1e-9


def corpus():
    rng = random.Random(6)
    common = ["the", "of", "and", "in", "to", "ß", "a"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("on er ha ti st é".split()) for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    items = {i: text(rng.choice([10, 15, 30, 60])) for i in range(25)}
    docs, leaks = [], set()
    for i in range(400):
        words = text(rng.choice([20, 150, 800]))
        if i % 4 == 0:
            item = rng.randrange(25)
            copy = list(items[item])
            for _ in range(len(copy) * (i % 3) // 10):  # up to a fifth of the words
                k = rng.randrange(len(copy))
                copy[k : k + 1] = rng.choice([[], [word()], [copy[k], word()]])
            at = rng.randrange(len(words))
            words[at:at] = [(w.capitalize() if w.isascii() else w) + rng.choice(["", ",", "."]) for w in copy]
            leaks.add((i, item, i % 3 == 0))
        docs.append((i, rng.choice([" ", "\n"]).join(words)))
    return docs, {i: " ".join(x) for i, x in items.items()}, leaks


def test_planted(spark):
    docs, items, leaks = corpus()
    long = (5000, docs[1][1] * 200 + " " + items[3])
    rows = docs + [(6000, None), (6001, ""), (None, docs[0][1]), docs[0], long]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").repartition(4)
    tests = [*items.items(), (90, None), (91, ""), (92, "of the"), (None, items[0]), (3, items[3])]
    benchmark = spark.createDataFrame([(*t, "x") for t in tests], "item_id long, text string, seed string")
    found = D.contaminated(frame, benchmark).collect()
    pairs = {(r.doc_id, r.item_id): r.score for r in found}
    assert len(pairs) == len(found)
    exact = {(d, i) for d, i, x in leaks if x} | {(5000, 3)}
    assert all(abs(pairs[p] - 1) < 1e-9 for p in exact)
    edited = {(d, i) for d, i, x in leaks if not x}
    assert len(edited & pairs.keys()) >= 0.95 * len(edited)
    assert len(pairs.keys() - exact - edited) <= 1


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, benchmark).collect() == []
    tests = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert D.contaminated(docs.limit(0), tests).collect() == []
    assert [r.score for r in D.contaminated(docs, tests).collect()] == [1.0]


def test_bound():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a, b = rng.integers(0, 9, rng.integers(1, 30)), rng.integers(0, 9, rng.integers(1, 60))
        assert D.bound(a, b) >= plain(a, b) - 1e-9


def test_every_copy_that_scores_and_shares_a_seed(spark):
    rng = random.Random(8)
    new = lambda: "".join(rng.choice("on er ha ti st ka mu".split()) for _ in range(6))
    items = {i: [new() for _ in range(rng.randrange(16, 56))] for i in range(60)}
    docs = {}
    for i, item in items.items():
        changed = set(range(4, len(item), 5)) if i % 4 == 0 else set(
            rng.sample(range(len(item)), round(len(item) * (0.15, 0.2, 0.3)[i % 3]))
        )
        copy = [new() if k in changed else w for k, w in enumerate(item)]
        docs[i] = [new() for _ in range(20)] + copy + [new() for _ in range(20)]
    docs[1000] = [new() for _ in range(9)] + items[7]  # an exact copy beside the edited one
    seeds = lambda words: {tuple(words[k : k + D.SEED]) for k in range(len(words) - D.SEED + 1)}
    scores = {
        (d, i): plain(items[i], words)
        for d, words in docs.items()
        for i in items
        if seeds(items[i]) & seeds(words)
    }
    expected = {p for p, score in scores.items() if score >= D.needed(len(items[p[1]]))}
    assert {(7, 7), (1000, 7), *((i, i) for i in range(0, 60, 4))} <= expected
    assert len(expected) > 45
    rows = [(d, " ".join(words)) for d, words in docs.items()]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(
        [(i, " ".join(words)) for i, words in items.items()], "item_id long, text string"
    )
    found = D.contaminated(frame, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    for r in found:
        assert abs(r.score * len(items[r.item_id]) - scores[r.doc_id, r.item_id]) < 1e-6
