"""The network's gradients against differences, and its accuracy on held-out texts."""

import random

import numpy as np

from rillhouse.llm import language_id as L

SYLLABLES = {"aa": "the ing on er th and", "bb": "ción que ó ll ñ ado", "cc": "ß ung ä sch keit der"}


def sentences(lang, rng, n):
    parts = SYLLABLES[lang].split()
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    return " ".join(word() for _ in range(n))


def corpus():
    rng = random.Random(2)
    return [(i, sentences(lang, rng, rng.choice([12, 60, 400])), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]


def test_gradients():
    rng = np.random.default_rng(0)
    net = L.train([b"ab"], np.array([0]), ["x", "y"], hidden=3, seed=4)
    for d in (net.forward, net.backward):
        d.byte, d.state, d.label = (w.astype(np.float64) for w in (d.byte, d.state, d.label))
    codes = rng.integers(0, 5, (6, 4))
    codes[4:, 1] = L._PAD
    labels = np.array([0, 1, 1, 0])
    _, found = L._gradients(net, codes, labels)
    weights = [w for d in (net.forward, net.backward) for w in (d.byte, d.state, d.label)]
    for w, g in zip(weights, found):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in w.shape)
            kept, w[at] = w[at], w[at] + 1e-3
            up = L._gradients(net, codes, labels)[0]
            w[at] = kept - 1e-3
            down = L._gradients(net, codes, labels)[0]
            w[at] = kept
            assert abs((up - down) / 2e-3 - g[at]) < 2e-4


def test_languages(spark):
    texts = corpus()
    rows = [(i, t, lang, "clash") for i, t, lang in texts]
    rows += [(1000, None, "aa", ""), (1001, "", "aa", ""), (1002, "123 !! 456", "bb", ""), (None, texts[0][1], None, "")]
    rows += [(1003, texts[1][1] * 300, None, ""), rows[5], (1004, "кошка", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    found = L.predict(docs, L.fit(docs)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1000, 1001, 1002))
    assert by_id[1004].lang_pred in SYLLABLES and by_id[None].lang_pred == "aa"
    assert by_id[1003].lang_pred == "bb"
    assert sum(by_id[1003].positions) == len((texts[1][1] * 300).encode())
    right = [by_id[i].lang_pred == lang for i, _, lang in texts]
    assert np.mean(right) > 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_a_short_text_is_read_as_alone():
    net = L.train([b"the on ing", "ción ó".encode()] * 40, np.array([0, 1] * 40), ["a", "b"], hidden=4)
    data = np.frombuffer(b"abc", np.uint8)
    codes, _ = L._windows(data, np.array([0, 3]))
    alone = net.label_scores(np.array([[97], [98], [99]]))
    assert np.allclose(net.label_scores(codes)[:3], alone, atol=1e-5)


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.predict(empty, L.fit(empty)).collect() == []
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    row = L.predict(docs, L.fit(docs)).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


#: Syllables of languages that nothing is labelled with.
FOREIGN = {"xx": "про ст ени ова", "yy": "吾輩 は猫 である", "zz": "kyv wrz xqu jaak vuo", "vv": "χρό νος και"}


def gibberish(rng, n):
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def foreign(lang, rng, n):
    parts = FOREIGN[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def test_unlabelled_languages_and_gibberish_go(spark):
    rng = random.Random(6)
    texts = corpus()
    clean = [(2000 + i, sentences(lang, rng, rng.choice([1, 2, 5, 12])), None) for i, lang in enumerate(list(SYLLABLES) * 80)]
    odd = [(3000 + i, foreign(lang, rng, 20), None) for i, lang in enumerate(list(FOREIGN) * 20)]
    odd += [(4000 + i, gibberish(rng, 20), None) for i in range(80)]
    mixed = [(5000, sentences("aa", rng, 10) + ' token = "9dd3c80004c73dc9e548fee51" +1 (706) 555-3138', None)]
    rest = [(6000, None, "aa"), (6001, "", "bb"), (6002, "12 !! 4", "aa"), mixed[0], (None, texts[0][1], None)]
    rows = [(*r, "clash") for r in texts + clean + odd + mixed + rest]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string").repartition(4)
    found = L.keep_known(docs, *L.fit_known(docs))
    assert found.schema == docs.schema
    found = found.collect()
    kept = [r.doc_id for r in found]
    assert sum(i in kept for i, *_ in clean) >= 0.98 * len(clean)
    assert sum(i in kept for i, *_ in texts) >= 0.99 * len(texts)
    assert sum(i in kept for i, *_ in odd) <= 0.1 * len(odd)
    assert kept.count(5000) == 2 and None in kept
    assert not {6000, 6001, 6002} & set(kept)


def test_spelling_of_plain_loops():
    """Pairs and means as counted text by text."""
    rng = random.Random(7)
    windows = sorted((lang, sentences(lang, rng, 9).encode()[:64]) for lang in list(SYLLABLES) * 20)
    model = L.fit_spelling(windows)
    texts = ["Ab é", "", "12 3", "x9y zz!", "a1", "The Ing, on\nth", "--", sentences("bb", rng, 30)]
    data, offsets = L._joined([t.encode() for t in texts])
    mean, size = model.means(data, offsets)
    for text, m, n in zip(texts, mean, size):
        tokens = text.replace("\n", " ").split(" ")
        plain = [t for t in tokens if not any(c.isdigit() for c in t)]
        if not any(c.isalpha() for t in plain for c in t):
            plain = tokens
        sums, pairs = np.zeros(len(model.pairs)), 0
        for i, token in enumerate(plain):
            last = 32
            # The space before a token belongs to it, that of the text's start does not count.
            for byte in token.encode():
                now = int(L._FOLD[byte])
                if (last, now) != (32, 32):
                    sums += model.pairs[:, last * 256 + now]
                    pairs += 1
                last = now
            following = tokens.index(token) + 1 < len(tokens) if plain is tokens else i + 1 < len(plain)
            if last != 32 and following:
                sums += model.pairs[:, last * 256 + 32]
                pairs += 1
        if text not in ("x9y zz!", "a1"):
            assert n == pairs, text
            assert abs(m - (sums / max(pairs, 1)).max()) < 1e-9
    assert size[1] == size[2] == size[6] == 0 and size[4] > 0
    assert model.known(data, offsets)[[1, 2, 6]].all()


def test_no_spelling_without_labels(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert L.keep_known(docs, *L.fit_known(docs)).collect() == []
    assert L.keep_known(docs.limit(0), *L.fit_known(docs.limit(0))).collect() == []
