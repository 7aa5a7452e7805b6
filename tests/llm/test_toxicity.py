"""Held-out accuracy on planted words, and the label model on simulated voters."""

import random
import zlib

import numpy as np

from rillhouse.llm import toxicity as T


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("the on ing er th and ou ß é".split()) for _ in range(rng.randint(1, 4)))
    rude = ["grumpf", "blarg", "snork", "vequ", "zottel"]
    texts, marks = [], []
    for i in range(600):
        words = [word() for _ in range(rng.choice([20, 80, 200]))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(1, 6) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(rude) + rng.choice(["", "er", "ing", ","]))
        texts.append(" ".join(words))
        marks.append(int(toxic))
    return texts, marks


def test_held_out_accuracy(spark):
    texts, marks = corpus()
    rows = [(i, t, 0.0) for i, t in enumerate(texts)]
    rows += [(9000, None, 0.0), (9001, "", 0.0), (None, texts[0], 0.0), rows[0], (9002, "Blarg grumpfer " * 15_000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    known = [(i, m, "x") for i, m in enumerate(marks)] + [(3, None, "x"), (None, 1, "x"), (77_777, 1, "x")]
    labels = spark.createDataFrame(known, "doc_id long, toxic int, features string")
    found = T.score(docs, T.fit(docs, labels)).collect()
    assert len(found) == len(rows)
    score = {r.doc_id: r.score for r in found}
    held = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80
    assert np.mean([(score[i] >= 0.5) == marks[i] for i in held]) > 0.95
    assert score[9000] == score[9001] < 0.1 and score[9002] > 0.5 and score[None] == score[0]
    assert all(0 <= r.score <= 1 for r in found)


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score < 1e-9 for r in T.score(docs, T.fit(docs, labels)).collect()] == [True, True]
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels)).collect() == []


def test_label_model():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.3
    rates = np.array([[0.02] * 5, [0.6, 0.5, 0.7, 0.4, 0.6]])
    votes = (rng.random((4000, 5)) < rates[truth.astype(int)]).astype(float)
    votes = np.column_stack([votes, votes[:, 0], votes.max(1) == 0])  # a copied voter, and the clean one
    start = np.where(votes[:, :5].sum(1) >= 2, 0.99, 0.01)
    model = T.fit_label_model(votes, np.ones(4000), start, prior=0.3, single=1)
    assert model.prior == 0.3
    assert model.correlations[0, 5] > 0.9 and model.weights[0] < 0.6 < model.weights[1]
    assert np.mean((model.posterior(votes) > 0.5) == truth) > 0.9


def test_counts_of_words():
    text = "Abcdef abcdef ABCDEF, xyzzyx".encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    keys, rows = T._features(data, offsets)
    # three hashes of the first word's beginnings less its own length, each once, twice and thrice
    assert len(keys) == len(set(keys.tolist())) == 3 * 3 + 3
    assert set(rows.tolist()) == {0}
    known = np.sort(keys)
    again, _ = T._features(data, offsets, known)
    assert sorted(again.tolist()) == sorted(keys.tolist())
