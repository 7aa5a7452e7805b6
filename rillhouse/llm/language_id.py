"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of labelled texts, a
bounded sample. Every text is read whole, in windows of ``WINDOW`` bytes side by side: each byte gets
a distribution over the languages from the states of both directions, and a document's distribution
is the normalised geometric mean of its bytes'. Gates and states use ``x / (1 + |x|)`` in place of
the exponential functions, which cost most of the time otherwise.

The network always prefers one of its languages, however foreign a text is. ``keep_known`` therefore
also asks for spelling: the log-likelihood of the pairs of letters, by the best of the languages, must
come up to what held-back windows of labelled texts show. Random letters and languages of another
spelling or script do not; one whose spelling is close to a labelled language's does.

A null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was
labelled. Equal texts get equal results; null and repeated ids keep their rows; of the input only the
named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rillhouse.llm.arrow import PIECE_BYTES, lists, pieces, text_bytes

UNKNOWN = "und"
#: Bytes of a window when texts are read.
WINDOW = 128
#: The sample: documents of each language, and windows of each document, in training.
DOCUMENTS, WINDOWS, TRAINED = 600, 6, 64
HIDDEN = 12
EPOCHS, BATCH, RATE = 3, 192, 0.01
#: Steps of training at least: a small sample is gone through more often.
STEPS = 240
#: Spelling: one window in so many is held back, the share of these that may fall short, and how far
#: below that share (nats a pair) and how many standard errors a text may lie.
HELD_BACK, SHORT_SHARE, SLACK, ERRORS = 4, 0.001, 0.5, 4.0
_PAD = 256
_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = regex.compile(r"\p{L}")


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


@dataclass
class Direction:
    """Weights of one direction: of bytes (3H x 257), of the state (3H x H), and to the labels (K x H).

    The rows are those of the reset gate, the update gate and the candidate state.
    """

    byte: np.ndarray
    state: np.ndarray
    label: np.ndarray

    def step(self, codes: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state (H x N) and what the backward pass needs."""
        size = len(h)
        given = np.take(self.byte, codes, axis=1)
        past = self.state @ h
        gates = past[: 2 * size]
        gates += given[: 2 * size]
        scale = np.abs(gates)
        scale += 1
        gates /= scale
        gates *= 0.5
        gates += 0.5
        r, z = gates[:size], gates[size:]
        c = past[2 * size :]
        n = given[2 * size :]
        n += r * c
        scale = np.abs(n)
        scale += 1
        n /= scale
        new = h - n
        new *= z
        new += n
        return new, r, z, n, c


@dataclass
class Network:
    """Languages and weights; ``bias`` has one number for each language."""

    languages: list[str]
    forward: Direction
    backward: Direction
    bias: np.ndarray

    def label_scores(self, codes: np.ndarray) -> np.ndarray:
        """Scores (T x K x N) of every position of windows (T x N)."""
        scores = np.empty((len(codes), len(self.languages), codes.shape[1]), np.float32)
        for direction, times in ((self.forward, range(len(codes))), (self.backward, range(len(codes) - 1, -1, -1))):
            h = np.zeros((direction.state.shape[1], codes.shape[1]), np.float32)
            for t in times:
                h = direction.step(codes[t], h)[0]
                if (codes[t] == _PAD).any():
                    h *= codes[t] != _PAD
                if direction is self.forward:
                    np.matmul(direction.label, h, out=scores[t])
                    scores[t] += self.bias
                else:
                    scores[t] += direction.label @ h
        return scores


def _log_softmax(scores: np.ndarray) -> np.ndarray:
    """Over the last axis but one."""
    scores = scores - scores.max(-2, keepdims=True)
    return scores - np.log(np.exp(scores).sum(-2, keepdims=True))


def _gradients(net: Network, codes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of the weights, by backpropagation through time.

    ``codes`` is T x N, ``labels`` the language of each of the N windows.
    """
    times, batch = codes.shape
    real = (codes != _PAD).astype(np.float32)
    kept = []
    scores = np.repeat(net.bias[None], times, 0).astype(np.float32).repeat(batch, 2)
    for direction, order in ((net.forward, range(times)), (net.backward, range(times - 1, -1, -1))):
        h = np.zeros((direction.state.shape[1], batch), np.float32)
        steps = {}
        for t in order:
            new, r, z, n, c = direction.step(codes[t], h)
            new *= real[t]
            steps[t] = (h, new, r, z, n, c)
            h = new
            scores[t] += direction.label @ h
        kept.append((direction, order, steps))
    logs = _log_softmax(scores)
    total = max(real.sum(), 1.0)
    loss = float(-(logs[:, labels, np.arange(batch)] * real).sum() / total)
    wrong = np.exp(logs)
    wrong[:, labels, np.arange(batch)] -= 1
    wrong *= (real / total)[:, None, :]
    found = []
    for direction, order, steps in kept:
        size = direction.state.shape[1]
        by_byte = np.zeros_like(direction.byte)
        by_state = np.zeros_like(direction.state)
        by_label = np.zeros_like(direction.label)
        carry = np.zeros((size, batch), np.float32)
        rows = np.arange(3 * size)[:, None] * direction.byte.shape[1]
        for t in reversed(order):
            h, new, r, z, n, c = steps[t]
            by_label += wrong[t] @ new.T
            carry = (carry + direction.label.T @ wrong[t]) * real[t]
            candidate = carry * (1 - z) * (1 - np.abs(n)) ** 2
            slope = lambda g: 0.5 * (1 - np.abs(2 * g - 1)) ** 2
            reset = candidate * c * slope(r)
            update = carry * (h - n) * slope(z)
            gates = np.concatenate([reset, update, candidate * r])
            by_state += gates @ h.T
            given = np.concatenate([reset, update, candidate])
            by_byte += np.bincount(
                (rows + codes[t]).ravel(), given.ravel(), by_byte.size
            ).reshape(by_byte.shape)
            carry = carry * z + direction.state.T @ gates
        found += [by_byte, by_state, by_label]
    return loss, [*found, wrong.sum((0, 2))[:, None]]


def train(
    windows: list[bytes], labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, seed: int = 1
) -> Network:
    """A network from labelled windows of at most ``TRAINED`` bytes, by Adam."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    net = Network(
        languages,
        *(
            Direction(small(3 * hidden, 257), small(3 * hidden, hidden), small(len(languages), hidden))
            for _ in range(2)
        ),
        np.zeros((len(languages), 1), np.float32),
    )
    codes = np.full((len(windows), TRAINED), _PAD, np.int64)
    for row, window in enumerate(windows):
        codes[row, : len(window)] = np.frombuffer(window, np.uint8)
    weights = [w for d in (net.forward, net.backward) for w in (d.byte, d.state, d.label)] + [net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    each = -(-len(windows) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // each))
    step, steps = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            _, gradients = _gradients(net, np.ascontiguousarray(codes[some].T), labels[some])
            step += 1
            rate = RATE * (1 - 0.9 * step / steps)
            for w, g, m, v in zip(weights, gradients, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(key: str = "doc_id") -> Column:
    """Documents that nothing is learned from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each text, evenly spaced, cut where a character begins."""
    for batch in pieces(batches):
        found, labels = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            data = text.encode()
            n = min(WINDOWS, max(1, len(data) // TRAINED))
            for i in range(n):
                at = i * max(len(data) - TRAINED, 0) // max(n - 1, 1)
                while at < len(data) and data[at] & 0xC0 == 0x80:
                    at += 1
                if data[at : at + TRAINED]:
                    found.append(data[at : at + TRAINED])
                    labels.append(label)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.binary()), pa.array(labels, pa.string())], names=["window", "label"]
        )


def _sample(docs: DataFrame, key: str, text: str, label: str) -> list[tuple[str, bytes]]:
    """(language, window) of the sample, sorted."""
    rows = docs.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(text).alias("text"))
    rows = rows.where(~held_out("id") & F.col("label").isNotNull() & F.col("text").rlike(r"\p{L}"))
    first = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = rows.select("id", "label").withColumn("rank", F.row_number().over(first))
    chosen = chosen.where(F.col("rank") <= DOCUMENTS).select(F.col("id").alias("chosen_id")).distinct()
    sample = rows.join(F.broadcast(chosen), F.col("id") == F.col("chosen_id"), "left_semi")
    found = sample.select("text", "label").mapInArrow(_cut, "window binary, label string").collect()
    return sorted((r.label, bytes(r.window)) for r in found)


def _network(found: list[tuple[str, bytes]]) -> Network:
    languages = sorted({x for x, _ in found})
    if not languages:
        empty = Direction(*(np.zeros(s, np.float32) for s in ((3, 257), (3, 1), (0, 1))))
        return Network([], empty, empty, np.zeros((0, 1), np.float32))
    labels = np.array([languages.index(x) for x, _ in found])
    return train([w for _, w in found], labels, languages)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Network:
    """Trains on at most ``DOCUMENTS`` documents of each language, ``WINDOWS`` windows of each.

    They are the first by a hash of their id; held-out documents and those without a label or text
    are left out.
    """
    return _network(_sample(docs, key, text, label))


def fit_known(
    docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang"
) -> tuple[Network, Spelling]:
    """The network and the spelling of its languages, from the same sample."""
    found = _sample(docs, key, text, label)
    return _network(found), fit_spelling(found)


@dataclass
class Spelling:
    """Log probabilities of pairs of folded bytes (languages x 65,536), and what a text must reach."""

    pairs: np.ndarray
    least: float
    deviation: float

    def means(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood a pair of each text by its best language, and the number of its pairs."""
        codes, rows = _letter_pairs(data, offsets)
        size = np.bincount(rows, minlength=len(offsets) - 1)
        sums = [np.bincount(rows, table[codes], len(size)) for table in self.pairs]
        return np.max(sums, 0) / np.maximum(size, 1), size

    def known(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text is spelled like one of the languages; one without a pair passes."""
        if not len(self.pairs):
            return np.ones(len(offsets) - 1, bool)
        mean, size = self.means(data, offsets)
        return (size == 0) | (mean >= self.least - ERRORS * self.deviation / np.sqrt(np.maximum(size, 1)))


def _letter_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a folded byte after another, and their texts.

    A-Z count as a-z and all but letters as a space; pairs of two spaces are left out, and so are
    tokens with a digit, as numbers and keys belong to no language, unless a text has no others.
    """
    folded = _FOLD[data]
    before = np.empty_like(folded)
    before[1:] = folded[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = 32
    gap = _SPACE[data]
    gap[offsets[:-1][offsets[:-1] < len(data)]] = True
    token = np.cumsum(gap)
    coded = np.bincount(token[_DIGIT[data]], minlength=(int(token[-1]) if len(token) else 0) + 1) > 0
    at = np.flatnonzero((folded != 32) | (before != 32))
    rows = np.searchsorted(offsets, at, side="right") - 1
    plain = ~coded[token[at]]
    plain |= (np.bincount(rows[plain], minlength=len(offsets)) == 0)[rows]
    at, rows = at[plain], rows[plain]
    return before[at].astype(np.int64) * 256 + folded[at], rows


def fit_spelling(found: list[tuple[str, bytes]]) -> Spelling:
    """Counts of pairs in each language's windows; those held back set what a text must reach."""
    tables, held = [], [w for i, (_, w) in enumerate(found) if i % HELD_BACK == 0]
    for language in sorted({x for x, _ in found}):
        windows = [w for i, (x, w) in enumerate(found) if x == language and i % HELD_BACK]
        counts = np.bincount(_letter_pairs(*_joined(windows))[0], minlength=1 << 16).reshape(256, 256)
        single = counts.sum(0) + 0.5
        joint = counts + 20 * single / single.sum()
        tables.append(np.log(0.99 * joint / joint.sum(1, keepdims=True) + 0.01 / 256).ravel())
    if not tables:
        return Spelling(np.zeros((0, 1 << 16)), 0.0, 0.0)
    model = Spelling(np.array(tables), 0.0, 0.0)
    mean, size = model.means(*_joined(held))
    mean, size = mean[size > 0], size[size > 0]
    if not len(mean):
        return Spelling(np.zeros((0, 1 << 16)), 0.0, 0.0)
    # Of a single pair, as the windows show it: their own spread, times the root of their size.
    model.deviation = float(np.sqrt(np.mean(size * (mean - mean.mean()) ** 2)))
    reached = mean + ERRORS * model.deviation / np.sqrt(size)
    model.least = float(np.quantile(reached, SHORT_SHARE)) - SLACK
    return model


def _joined(windows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in windows], dtype=np.int64)]).astype(np.int64)
    return np.frombuffer(b"".join(windows), np.uint8), offsets


def _windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (T x N) of all texts' windows, and the text of each window."""
    sizes = np.diff(offsets)
    per_text = -(-sizes // WINDOW)
    rows = np.repeat(np.arange(len(sizes)), per_text)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    starts = offsets[rows] + within * WINDOW
    at = starts + np.arange(WINDOW)[:, None]
    codes = data[np.minimum(at, max(len(data) - 1, 0))].astype(np.int64)
    codes[at >= offsets[rows + 1]] = _PAD
    return codes, rows


def _has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    lower = data | 0x20
    ascii_letter = (lower >= 97) & (lower <= 122)
    sums = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = sums[offsets[1:]] > sums[offsets[:-1]]
    for row in np.flatnonzero(~found & (np.diff(offsets) > 0)).tolist():
        found[row] = bool(_LETTER.search(data[offsets[row] : offsets[row + 1]].tobytes().decode()))
    return found


def label_texts(net: Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and positions by language of each text."""
    k, rows = len(net.languages), len(column)
    data, offsets = text_bytes(column)
    if not k:
        return np.full(rows, UNKNOWN, object), np.zeros(rows), np.zeros((rows, 0), np.int64)
    logs, positions = np.zeros((k, rows)), np.zeros((rows, k), np.int64)
    codes, texts = _windows(data, offsets)
    # A long text is read in blocks of windows, so that the network's memory does not grow with it.
    for at in range(0, len(texts), 8192):
        part, owners = codes[:, at : at + 8192], texts[at : at + 8192]
        found = _log_softmax(net.label_scores(np.ascontiguousarray(part)))
        real = part != _PAD
        found *= real[:, None, :]
        best = found.argmax(1)
        for i in range(k):
            logs[i] += np.bincount(owners, found[:, i].sum(0), rows)
            positions[:, i] += np.bincount(owners, ((best == i) & real).sum(0), rows).astype(np.int64)
    known = _has_letter(data, offsets)
    mean = _log_softmax(logs / np.maximum(np.diff(offsets), 1))
    names = np.where(known, np.array(net.languages, object)[mean.argmax(0)], UNKNOWN)
    return names, np.where(known, np.exp(mean.max(0)), 0.0), positions


def predict(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, positions) of each text.

    ``score`` is the document probability of the predicted language; ``positions`` has the number of
    bytes labelled with each of the network's languages.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            names, score, positions = label_texts(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(names.tolist(), pa.string()),
                    pa.array(score, pa.float64()),
                    lists(positions.ravel(), np.full(len(batch), positions.shape[1]), pa.int64()),
                ],
                names=["id", "lang_pred", "score", "positions"],
            )

    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    found = docs.mapInArrow(run, f"id {kind}, lang_pred string, score double, positions array<long>")
    return found.withColumnRenamed("id", key)


def keep_known(docs: DataFrame, net: Network, spelling: Spelling, text: str = "text") -> DataFrame:
    """The rows, with all columns, whose language the network names and the spelling confirms."""

    @F.arrow_udf("boolean")
    def known(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        found = [pa.array([], pa.bool_())]
        # Small pieces: the network's states take some 150 bytes a byte of text.
        for piece in pieces([batch], size=PIECE_BYTES // 4):
            names, _, _ = label_texts(net, piece.column("text"))
            found.append(pa.array((names != UNKNOWN) & spelling.known(*text_bytes(piece.column("text")))))
        return pa.concat_arrays(found)

    # Only the texts go to the model and only its verdict comes back.
    return docs.where(known(F.col(text)))
