"""Statistics against plain loops, rules against the labels they were learned from."""

import random
import re
from collections import Counter

import numpy as np

from rillhouse.llm import quality_rules as Q

WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("théñ on ing ß".split()) for _ in range(rng.randint(1, 5)))
    good = ["\n".join(" ".join(word() for _ in range(9)) for _ in range(12)) for _ in range(120)]
    bad = [re.sub(" ", lambda _: rng.choice(["&&& ", "%%% ", " "]), t) for t in good[:60]]
    bad += ["\n".join([t.split("\n")[0]] * 9) for t in good[60:90]]
    odd = [None, "", " \n\t", "a", "a a a a", "x\n\nx\n \n x\r\nx\r", "é" * 70_000, "w w " * 9_000, "\n" * 500, "a\x0bb"]
    return good, bad, odd


def test_statistics(spark):
    good, bad, odd = texts()
    rows = [(i, t, 0) for i, t in enumerate(odd + good + bad)]
    rows += [rows[3], (None, rows[4][1], 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(3)
    found = Q.statistics(docs).collect()
    expected = [(i, *plain(t)) for i, t, _ in rows]
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, *(r[c] for c in Q.COUNTS[:5]))) for r in found)
    assert all(r[f] is not None for r in found for f in Q.FEATURES)


def test_rules(spark):
    good, bad, odd = texts()
    rows = list(enumerate(good + bad + odd))
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    marks = [(i, int(i < len(good)), "x") for i in range(len(good) + len(bad))] + [(1, None, "x"), (None, 0, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, n_words string")
    rules = Q.fit(Q.labelled(docs, labels))
    assert rules
    found = Q.statistics(docs).select("doc_id", Q.verdict(rules).alias("rule")).collect()
    rejected = {r.doc_id for r in found if r.rule is not None}
    assert np.mean([i in rejected for i in range(len(good), len(good) + len(bad))]) > 0.95
    assert not any(i in rejected for i in range(len(good)))


def test_rules_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = Q.fit(Q.labelled(docs, labels))
    assert rules == []
    assert Q.statistics(docs).select(Q.verdict(rules).alias("rule")).first().rule is None
    assert Q.statistics(docs.limit(0)).collect() == []


def test_pruning_drops_conditions_that_do_not_hold():
    values = {"a": np.arange(100.0), "b": np.arange(100.0)[::-1].copy()}
    low = values["a"] >= 60
    rule = (Q.Condition("a", True, 60.0), Q.Condition("b", True, 30.0))
    assert Q._prune(rule, values, low) == rule[:1]
    assert [Q._fits(r, values).tolist() for r in Q.learn(values, low)] == [low.tolist()]
