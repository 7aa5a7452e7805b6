"""Toxicity by weak supervision.

Labelled documents show which words and word beginnings occur in toxic texts more often than chance
allows; dealt over lexicons, each lexicon is a voter, and so are a few patterns of writing. A
generative label model (two hidden classes, a vote rate of each voter in each class) is fitted to the
votes by expectation maximisation; a lexicon or pattern without a match abstains, which says nothing,
one more voter speaks against toxicity where no lexicon matches, and the label itself is a fallible
voter either way. Voters that still agree beyond
their classes are correlated, and count the less the more correlated they are. A linear classifier over the words, word beginnings and
patterns is trained on the model's posterior labels and scores every whole text.

Texts that share their rarest-hash five words count as one when evidence is counted, so that copies
of a text prove no more than the text does. Null and empty texts get the score of a text without any
word; repeated rows and null or equal ids keep their rows; labels of null or of unknown documents are
no labels, and the highest of several counts. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.arrow import lists, pieces, text_bytes
from rillhouse.llm.tables import written
from rillhouse.llm.words import mix, row_sums, span_hashes, window_hashes, window_starts, words_of

#: The sample: toxic and other labelled documents, the first of each by a hash of their id.
TOXIC, CLEAN = 3_000, 6_000
#: Words and beginnings that the classifier knows, and lexicons that vote.
FEATURES, LEXICONS = 1_024, 24
#: Share of unrelated words among those that pass as evidence.
CHANCE = 0.05
#: Share of the clean sample in which a word may occur, against the toxic one.
PURITY = 0.02
#: Weight decay of the classifier.
DECAY = 2e-5
BEGINNINGS = (4, 5, 6)
PATTERNS = ("shouting", "marks", "repeats")
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?")] = True


def _starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of each text, and their texts."""
    letters = _LETTERS[data]
    words = words_of(letters, offsets)
    rows = words.rows
    keys, owners = [words.hashes], [rows]
    sizes = words.ends - words.starts
    wide = letters.astype(np.uint64) + np.uint64(1)
    for n in BEGINNINGS:
        long = np.flatnonzero(sizes > n)
        start = words.starts[long]
        at = np.zeros(len(long), np.uint64)
        for i in range(n):
            at = (at << np.uint64(9)) + wide[start + i]
        keys.append(mix(at + np.uint64(n << 58)))
        owners.append(rows[long])
    return np.concatenate(keys), np.concatenate(owners)


def _times(n: int) -> np.uint64:
    """What turns the hash of a beginning into that of its ``n`` occurrences."""
    return np.uint64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def _features(
    data: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and beginnings of each text, each once, and their texts.

    One that occurs again counts as a second feature, and as a third from three times on. Of
    ``known`` hashes, only those and what may become one of them are looked at.
    """
    keys, rows = _starts(data, offsets)
    if known is not None:
        once = [np.sort(known ^ _times(n)) for n in (2, 3)]
        found = [_look_up(keys, k)[0] for k in (known, *once)]
        at = np.unique(np.concatenate(found))
        keys, rows = keys[at], rows[at]
    order = np.lexsort((keys, rows))
    keys, rows = keys[order], rows[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(keys)))
    keys, rows = keys[first], rows[first]
    more = [keys, *(keys[count >= n] ^ _times(n) for n in (2, 3))]
    return np.concatenate(more), np.concatenate([rows, *(rows[count >= n] for n in (2, 3))])


def _patterns(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of the patterns (texts x patterns)."""
    size = np.maximum(np.diff(offsets), 1)
    upper, marks = row_sums(_UPPER[data], offsets), row_sums(_MARK[data], offsets)
    words = words_of(data, offsets, lower=True)
    same = np.zeros(len(words.hashes), bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    repeats = row_sums(same, words.bounds)
    return np.column_stack(
        [upper > 0.4 * size, marks > 0.05 * size, repeats > 0.1 * np.maximum(words.counts, 1)]
    )


def _signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least hash of five consecutive words of each text."""
    words = words_of(data, offsets, lower=True)
    starts, counts = window_starts(words.bounds, 5)
    found = window_hashes(words.hashes, starts, 5)
    whole = span_hashes(words.hashes, words.bounds[:-1], words.bounds[1:])
    some = np.flatnonzero(counts)
    if len(some):
        whole[some] = np.minimum.reduceat(found, (np.cumsum(counts) - counts)[some])
    return whole


def _evidence(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, signature, toxic) of each text, features once."""
    for batch in pieces(batches):
        data, offsets = text_bytes(batch.column("text"))
        keys, rows = _features(data, offsets)
        signature = _signatures(data, offsets).view(np.int64)[rows]
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int32)[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array(signature), pa.array(toxic)],
            names=["feature", "signature", "toxic"],
        )


def _look_up(keys: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the keys that are among the sorted known ones, and their place there."""
    if not len(known) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.zeros(1 << 16, bool)
    near[known >> np.uint64(48)] = True
    maybe = np.flatnonzero(near[keys >> np.uint64(48)])
    place = np.minimum(np.searchsorted(known, keys[maybe]), len(known) - 1)
    hit = known[place] == keys[maybe]
    return maybe[hit], place[hit]


def _matches(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of the known features of each text, each once, sorted."""
    keys, rows = _features(data, offsets, known)
    at, place = _look_up(keys, known)
    pairs = np.unique(rows[at] * len(known) + place) if len(known) else np.empty(0, np.int64)
    return pairs // max(len(known), 1), pairs % max(len(known), 1)


@dataclass
class LabelModel:
    """Share of toxic texts, vote rates of each voter in either class, and weights for correlation."""

    prior: float
    rates: np.ndarray
    weights: np.ndarray
    correlations: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the toxic class of each row of 0/1 votes."""
        odds = votes @ (self.weights * (np.log(self.rates[1]) - np.log(self.rates[0])))
        return 1 / (1 + np.exp(-np.clip(odds + math.log(self.prior / (1 - self.prior)), -30, 30)))


def fit_label_model(
    votes: np.ndarray,
    weight: np.ndarray,
    start: np.ndarray,
    prior: float | None = None,
    single: int = 0,
    rounds: int = 40,
) -> LabelModel:
    """Expectation maximisation from first posteriors ``start``; rows count ``weight``.

    A given ``prior`` is kept; the last ``single`` voters are taken as independent of the others.
    """
    voters = votes.shape[1]
    model = LabelModel(0.5, np.zeros((2, voters)), np.ones(voters), np.eye(voters))
    belief = start
    for _ in range(rounds):
        shares = [weight * (1 - belief), weight * belief]
        model.prior = float(np.clip(prior or shares[1].sum() / weight.sum(), 1e-3, 1 - 1e-3))
        model.rates = np.stack([(s @ votes + 0.1) / (s.sum() + 1) for s in shares]).clip(1e-4, 1 - 1e-4)
        # What two voters share beyond their classes.
        residual = votes - belief[:, None] * model.rates[1] - (1 - belief[:, None]) * model.rates[0]
        cover = (residual * weight[:, None]).T @ residual / weight.sum()
        scale = np.sqrt(np.diag(cover)) + 1e-9
        model.correlations = cover / scale[:, None] / scale
        strong = np.where(model.correlations > 0.1, model.correlations, 0)
        np.fill_diagonal(strong, 0)
        strong[voters - single :] = strong[:, voters - single :] = 0
        model.weights = 1 / (1 + strong.sum(1))
        belief = model.posterior(votes)
    return model


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 15) -> np.ndarray:
    """Weights and bias of a logistic regression on soft labels, by Newton's method with weight decay."""
    x = np.column_stack([x, np.ones(len(x), x.dtype)])
    share = weight / weight.sum()
    decay = np.full(x.shape[1], DECAY)
    decay[-1] = DECAY / 100
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (share * np.maximum(p * (1 - p), 1e-6)).astype(x.dtype)
        bend = (x * slope[:, None]).T @ x + np.diag(decay)
        step = np.linalg.solve(bend, (share * (p - target)) @ x + decay * w)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
    return w


@dataclass
class Model:
    """Known features in order of their hash, the classifier's weights and the label model."""

    known: np.ndarray
    weights: np.ndarray
    labels: LabelModel | None


def held_out(key: str = "doc_id") -> Column:
    """Documents whose labels nothing is learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


def _sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(text, toxic) of the sample; its ids are broadcast, ``TOXIC + CLEAN`` at most."""
    known = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(key))
        .groupBy(F.col(key).alias("known_id"))
        .agg(F.max(label).cast("int").alias("toxic"))
    )
    first = [F.xxhash64("known_id"), F.col("known_id")]
    chosen = [
        known.where(F.col("toxic") == mark).orderBy(*first).limit(n) for mark, n in ((1, TOXIC), (0, CLEAN))
    ]
    chosen = chosen[0].unionByName(chosen[1])
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    joined = docs.join(F.broadcast(chosen), F.col("id") == F.col("known_id"))
    return joined.select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def _select(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features that occur in toxic texts more often than chance allows, sorted by hash.

    With them, how often each occurs in clean texts against toxic ones.
    """
    counted = (
        rows.mapInArrow(_evidence, "feature long, signature long, toxic int")
        .groupBy("feature", "signature")
        .agg(F.max("toxic").alias("toxic"))
        .groupBy("feature")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .where("t >= 3")
    )
    counted = written(counted, "toxicity-evidence")
    # Texts of each kind, counted by their signatures, and the features that were tried.
    sizes = (
        rows.mapInArrow(_marks(np.empty(0, np.uint64)), MARKS)
        .groupBy("signature")
        .agg(F.max("toxic").alias("toxic"))
        .groupBy()
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        .first()
    )
    if not sizes.t or not sizes.c:
        return np.empty(0, np.uint64), np.empty(0)
    base = sizes.t / (sizes.t + sizes.c)
    rate = (F.col("c") / sizes.c) / (F.col("t") / sizes.t)
    # Binomial deviance of t toxic among t + c texts against the base rate.
    share = F.col("t") / (F.col("t") + F.col("c"))
    deviance = F.col("t") * F.log(share / base) + F.when(
        F.col("c") > 0, F.col("c") * F.log((1 - share) / (1 - base))
    ).otherwise(0.0)
    tried = max(counted.count(), 1)
    ranked = (
        counted.where(rate < PURITY)
        .select("feature", rate.alias("rate"), deviance.alias("deviance"))
        .orderBy(F.desc("deviance"), "feature")
        .limit(FEATURES)
        .collect()
    )
    # The false discovery rate of Benjamini and Hochberg.
    passed = [math.exp(-r.deviance) <= CHANCE * i / tried for i, r in enumerate(ranked, 1)]
    chosen = ranked[: max((i for i, x in enumerate(passed, 1) if x), default=0)]
    known = np.array([r.feature for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], np.array([r.rate for r in chosen])[order]


MARKS = "signature long, toxic int, features array<int>, patterns array<int>"


def _marks(known: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            rows, place = _matches(data, offsets, known)
            votes = _patterns(data, offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_signatures(data, offsets).view(np.int64)),
                    batch.column("toxic").cast(pa.int32()),
                    lists(place.astype(np.int32), np.bincount(rows, minlength=len(batch)), pa.int32()),
                    lists(votes.ravel(), np.full(len(batch), votes.shape[1]), pa.int32()),
                ],
                names=["signature", "toxic", "features", "patterns"],
            )

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
) -> Model:
    """Learns from the bounded sample of labelled documents that are not held out."""
    rows = written(_sample(docs, labels, key, text, label), "toxicity-sample")
    known, rate = _select(rows)
    if not len(known):
        return Model(known, np.append(np.zeros(len(PATTERNS)), -40.0), None)
    marks = rows.mapInArrow(_marks(known), MARKS).orderBy("signature", "toxic", "features").collect()
    _, which, copies = np.unique([r.signature for r in marks], return_inverse=True, return_counts=True)
    weight = 1 / copies[which]
    x = np.zeros((len(marks), len(known) + len(PATTERNS)), np.float32)
    for row, mark in enumerate(marks):
        x[row, mark.features] = 1
        x[row, len(known) :] = mark.patterns
    toxic = np.array([r.toxic for r in marks], float)
    # Words that are about as exclusive to toxic texts make a lexicon.
    lexicon = np.argsort(np.argsort(rate, kind="stable")) * min(LEXICONS, len(known)) // len(known)
    votes = [x[:, : len(known)][:, lexicon == i].max(1) for i in range(lexicon.max() + 1)]
    clean = 1 - np.max(votes, 0)
    # The annotator votes as well, either way, and is as fallible as the model finds.
    votes = np.column_stack([*votes, x[:, len(known) :], clean, toxic, 1 - toxic])
    share = float(weight @ toxic / weight.sum())
    model = fit_label_model(votes, weight, np.where(toxic == 1, 0.99, 0.01), share, single=3)
    return Model(known, fit_linear(x, model.posterior(votes), weight), model)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, features): the probability of toxicity of each whole text, and its known features."""
    known, weights = model.known, model.weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            rows, place = _matches(data, offsets, known)
            odds = np.bincount(rows, weights[place], len(batch)) + weights[-1]
            odds += _patterns(data, offsets) @ weights[len(known) : -1]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40)))),
                    pa.array(np.bincount(rows, minlength=len(batch)), pa.int32()),
                ],
                names=["id", "score", "features"],
            )

    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    found = docs.mapInArrow(run, f"id {kind}, score double, features int")
    return found.withColumnRenamed("id", key)
