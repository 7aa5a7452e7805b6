"""Quality rules: statistics of each text, and a decision list learned from labelled ones.

Sequential covering: a rule is grown on two thirds of the labelled rows that are left, one threshold
condition after another, each the one with the greatest information gain; pruned on the other third
by dropping final conditions; and kept if it is precise enough on both. The rows that it covers go,
and the next rule is learned from the rest. The ordered list becomes one Spark conditional expression
over the statistics' columns.

Null and empty texts have zero in every statistic, and every ratio with a zero denominator is zero.
Repeated rows and null or equal ids keep their rows; only the two named columns are read. Documents
with several labels count as low if any label is; null labels are no labels. Without labels the list
is empty and no text is rejected by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.arrow import pieces, text_bytes
from rillhouse.llm.words import (
    byte_span_hashes,
    is_space,
    repeated,
    row_sums,
    window_hashes,
    window_starts,
    words_of,
)

#: Labelled rows to learn from: the first of all by a hash of their id.
SAMPLE = 20_000
#: Precision a rule needs on the rows it was grown and pruned on, and low rows it must cover.
PRECISION, COVER = 0.9, 5
CONDITIONS = 4
CANDIDATES = 64
COUNTS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_digits n_upper n_bars "
    "n_distinct_words"
).split()
#: Each ratio's numerator and denominator.
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "word_chars"),
    "digit_ratio": ("n_digits", "word_chars"),
    "upper_ratio": ("n_upper", "word_chars"),
    "bar_ratio": ("n_bars", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "distinct_ratio": ("n_distinct_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
}
FEATURES = ["n_words", *RATIOS]


def _table(symbols: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(symbols)] = True
    return found


_SYMBOL = _table(b"#*$%&|<>")
_DIGIT = _table(b"0123456789")
_UPPER = _table(bytes(range(65, 91)))


def _statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The counts of ``COUNTS`` for each text."""
    words = words_of(data, offsets)
    inside = ~is_space(data)
    newlines = np.flatnonzero(data == 10)
    n_lines = 1 + row_sums(data == 10, offsets)
    line_rows = np.repeat(np.arange(len(n_lines)), n_lines)
    starts = np.sort(np.concatenate([offsets[:-1], newlines + 1]))
    ends = np.sort(np.concatenate([newlines, offsets[1:]]))
    sums = np.concatenate([[0], np.cumsum(inside)])
    written = sums[ends] > sums[starts]
    starts, ends, line_rows = starts[written], ends[written], line_rows[written]
    _, duplicate = repeated(byte_span_hashes(data, starts, ends), line_rows)
    rows = len(offsets) - 1
    windows, per_text = window_starts(words.bounds, 3)
    again, _ = repeated(window_hashes(words.hashes, windows, 3), np.repeat(np.arange(rows), per_text))
    steps = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(steps, windows[again], 1)
    np.add.at(steps, windows[again] + 3, -1)
    _, seen = repeated(words.hashes, words.rows)
    return [
        words.counts,
        row_sums(inside & ((data & 0xC0) != 0x80), offsets),
        row_sums(_SYMBOL[data], offsets),
        np.bincount(line_rows[duplicate], minlength=rows),
        row_sums(np.cumsum(steps)[:-1] > 0, words.bounds),
        np.bincount(line_rows, minlength=rows),
        row_sums(_DIGIT[data], offsets),
        row_sums(_UPPER[data], offsets),
        row_sums(data == ord("|"), offsets),
        words.counts - row_sums(seen, words.bounds),
    ]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        found = _statistics(*text_bytes(batch.column("text")))
        columns = [pa.array(x, pa.int64()) for x in found]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", *COUNTS])


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, counts and ratios) of each whole text."""
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    counts = docs.mapInArrow(_count, ", ".join([f"id {kind}", *(f"{c} long" for c in COUNTS)]))
    ratios = {
        name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
        for name, (a, b) in RATIOS.items()
    }
    return counts.withColumns(ratios).withColumnRenamed("id", key)


@dataclass(frozen=True)
class Condition:
    """``feature >= threshold``, or ``<`` where ``least`` is false."""

    feature: str
    least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _fits(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    found = np.ones(len(next(iter(values.values()))), bool)
    for c in rule:
        found &= (values[c.feature] >= c.threshold) == c.least
    return found


def _grow(values: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    rule: list[Condition] = []
    covered = np.ones(len(low), bool)
    while len(rule) < CONDITIONS and (~low & covered).any():
        p0, n0 = (low & covered).sum(), (~low & covered).sum()
        best, gain = None, 0.0
        for feature, value in values.items():
            x, y = value[covered], low[covered]
            order = np.argsort(x, kind="stable")
            x, hits = x[order], np.concatenate([[0], np.cumsum(y[order])])
            cuts = np.unique(np.quantile(x, np.linspace(0, 1, CANDIDATES + 1)))
            below = np.searchsorted(x, cuts)
            for least in (True, False):
                p = hits[-1] - hits[below] if least else hits[below]
                n = (len(x) - below if least else below) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                at = int(np.argmax(gains))
                if gains[at] > gain + 1e-9:
                    best, gain = Condition(feature, least, float(cuts[at])), float(gains[at])
        if best is None:
            break
        rule.append(best)
        covered &= _fits((best,), values)
    return tuple(rule)


def _prune(rule: Rule, values: dict[str, np.ndarray], low: np.ndarray) -> Rule:
    def worth(candidate: Rule) -> float:
        covered = _fits(candidate, values)
        p, n = (low & covered).sum(), (~low & covered).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(values: dict[str, np.ndarray], low: np.ndarray) -> list[Rule]:
    """The ordered rules that say which rows are of low quality."""
    rules: list[Rule] = []
    part = np.random.default_rng(7).random(len(low)) < 2 / 3
    left = np.ones(len(low), bool)
    while (low & left).sum() >= COVER:
        grow = {k: v[left & part] for k, v in values.items()}
        rule = _grow(grow, low[left & part])
        prune = left & ~part
        rule = _prune(rule, {k: v[prune] for k, v in values.items()}, low[prune])
        covered = _fits(rule, values) & left
        hits = (low & covered).sum()
        if not rule or hits < COVER or hits < PRECISION * covered.sum():
            break
        rules.append(rule)
        left &= ~covered
    return rules


def fit(stats: DataFrame, key: str = "doc_id", label: str = "quality") -> list[Rule]:
    """The rules of at most ``SAMPLE`` labelled rows of statistics with a 0/1 label column (0 is low)."""
    rows = stats.where(F.col(label).isNotNull()).orderBy(F.xxhash64(key), *FEATURES).limit(SAMPLE)
    found = rows.select(*FEATURES, F.col(label).cast("int").alias("label")).toPandas()
    values = {f: found[f].to_numpy(float) for f in FEATURES}
    return learn(values, found["label"].to_numpy() == 0)


def labelled(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """Statistics of at most ``SAMPLE`` labelled documents, with their label.

    The sample's ids and labels are broadcast: ``SAMPLE`` rows at most.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("known_id"))
        .agg(F.min(label).alias("known_label"))
        .orderBy(F.xxhash64("known_id"), "known_id")
        .limit(SAMPLE)
    )
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    chosen = docs.join(F.broadcast(known), F.col("id") == F.col("known_id"), "left_semi")
    found = statistics(chosen, "id", "text").join(F.broadcast(known), F.col("id") == F.col("known_id"))
    return found.select(F.col("id").alias(key), *FEATURES, F.col("known_label").alias(label))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, from 1; null if none does."""
    found = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        fits = F.lit(True)
        for condition in rule:
            fits = fits & condition.column()
        found = F.when(fits, F.lit(number)).otherwise(found)
    return found


def base_failed() -> Column:
    """Fixed limits: fewer than 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
