"""Secret scans: fixed patterns, and random strings told from identifiers by Markov models.

Patterns, leftmost and non-overlapping for each kind: ``assign`` (a keyword, ``:`` or ``=``, and a
value of at least 8 characters), ``access`` (``AKIA`` and at least 16 characters in all) and ``hex``
(at least 32 characters); shorter matches are dropped.

First-order character models of random strings and of ordinary identifiers are compared. The corpus
trains one of each from the samples that the patterns label: the values they find, and all other runs
of key characters, which in upper case train one more of identifiers. Drawn strings of the usual key
alphabets (``ALPHABETS``, and dashed hexadecimal groups) train further models of random strings, and
counting or repeating characters (``abcdef``, ``0000``) are a last one of identifiers. A run with a
letter that no pattern covers is ``markov``, a secret, if the best model of random strings leads the
best one of identifiers by a log-likelihood ratio of ``RATIO`` in all and ``MEAN_RATIO`` a character.
Dots and dashes belong to a run, but not at its ends. Its length matters by the ratio alone, from
``COUNTED`` characters on. Identifiers of a form that the corpus hardly has (a version, a dotted name)
look random to a small corpus.

Spans are in code points, the end exclusive. Null and empty texts have none; repeated rows and null or
equal ids keep their rows; only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.arrow import pieces, text_bytes

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
#: Least run that the models count and judge.
COUNTED = 6
#: Log-likelihood ratio, in nats: of the run, and per character.
RATIO, MEAN_RATIO = 10.0, 0.5
#: Weight of the uniform distribution in the models of the corpus (secrets, identifiers), and in drawn ones.
SMOOTH, DRAWN_SMOOTH = (0.5, 0.1), 0.02
#: Samples that train the model of each alphabet: strings, and their length.
STRINGS, LENGTH = 4_000, 40
SPANS = "array<struct<kind string, start long, end long>>"
_CODES = np.zeros(256, np.int64)
_SYMBOLS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
#: Characters of common kinds of keys: hexadecimal, base 32, base 36, letters, base 62 and both base 64.
ALPHABETS = (
    _SYMBOLS[52:62] + _SYMBOLS[:6],
    _SYMBOLS[52:62] + _SYMBOLS[26:32],
    _SYMBOLS[26:52] + _SYMBOLS[54:60],
    _SYMBOLS[:26] + _SYMBOLS[52:62],
    _SYMBOLS[:52],
    _SYMBOLS[:62],
    _SYMBOLS[:62] + b"-_",
    _SYMBOLS[:62] + b"+/",
)
_CODES[list(_SYMBOLS)] = np.arange(1, len(_SYMBOLS) + 1)
N = len(_SYMBOLS) + 1
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_EDGE = np.zeros(256, bool)
_EDGE[list(b"-.")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(_SYMBOLS[:52])] = True
#: Models of random strings come first: the corpus's, one of each alphabet, dashed groups.
SECRET_MODELS = len(ALPHABETS) + 2
_SIGN = np.zeros(256, bool)
_SIGN[list(b":=")] = True


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of maximal runs within one text of at least ``least`` bytes."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[[0, -1]] = True
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = (ends - starts >= least) & inside[np.minimum(starts, max(len(inside) - 1, 0))]
    return starts[keep], ends[keep]


def pattern_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) in bytes of what the patterns find, sorted."""
    if not len(data):
        return []
    found = [(int(a), 2, int(b), int(a)) for a, b in zip(*_runs(_HEX[data], offsets, 32))]
    signs = np.unique(np.searchsorted(offsets, np.flatnonzero(_SIGN[data]), side="right") - 1)
    for row in signs.tolist():
        base = int(offsets[row])
        text = data[base : offsets[row + 1]].tobytes()
        found += [
            (base + m.start(), 0, base + m.end(), base + m.start(2))
            for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= 8
        ]
    whole, ends = data.tobytes(), offsets[1:]
    at = whole.find(b"AKIA")
    while at >= 0:
        end = int(ends[np.searchsorted(ends, at, side="right")])
        m = ACCESS.match(whole, at, end)
        if m and m.end() - at >= 16:
            found.append((at, 1, m.end(), at))
        at = whole.find(b"AKIA", m.end() if m else at + 1)
    return sorted(found)


def _covered(spans: list[tuple[int, int, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether any of the sorted spans overlaps each run."""
    if not spans:
        return np.zeros(len(starts), bool)
    first = np.array([s[0] for s in spans])
    reach = np.maximum.accumulate(np.array([s[2] for s in spans]))
    before = np.searchsorted(first, ends) - 1
    return (before >= 0) & (reach[before] > starts)


def _pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Codes of each character and its predecessor (0 at the start) of the spans, span after span."""
    sizes = ends - starts
    if not len(sizes):
        return np.empty(0, np.int64)
    within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = within + np.repeat(starts, sizes)
    codes = _CODES[data[at]]
    previous = np.where(within > 0, _CODES[data[np.maximum(at - 1, 0)]], 0)
    return previous * N + codes


def _key_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of runs of key characters, without dots and dashes at their ends."""
    starts, ends = _runs(_CODES[data] > 0, offsets, COUNTED)
    inner = np.flatnonzero((_CODES[data] > 0) & ~_EDGE[data])
    if not len(inner):
        return starts[:0], ends[:0]
    first = inner[np.minimum(np.searchsorted(inner, starts), len(inner) - 1)]
    last = inner[np.maximum(np.searchsorted(inner, ends) - 1, 0)] + 1
    keep = (first >= starts) & (last <= ends) & (last - first >= COUNTED)
    return first[keep], last[keep]


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, N * N), np.int64)
    for batch in pieces(batches):
        data, offsets = text_bytes(batch.column("text"))
        spans = pattern_spans(data, offsets)
        starts, ends = _key_runs(data, offsets)
        free = ~_covered(spans, starts, ends)
        for model, a, b in (
            (0, np.array([s[3] for s in spans], np.int64), np.array([s[2] for s in spans], np.int64)),
            (1, starts[free], ends[free]),
        ):
            counts[model] += np.bincount(_pairs(data, a, b), minlength=N * N)
    model, pair = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [pa.array(model, pa.int32()), pa.array(pair, pa.int32()), pa.array(counts[model, pair])],
        names=["model", "pair", "n"],
    )


def _chain(counts: np.ndarray, lean: float, uniform: float) -> np.ndarray:
    """Log probabilities of each character after another (N x N), from counts of pairs.

    A character with few samples leans on the distribution of single characters.
    """
    single = counts.sum(0) + 1.0
    joint = counts + lean * single / single.sum()
    return np.log((1 - uniform) * joint / joint.sum(1, keepdims=True) + uniform / (N - 1))


def _drawn() -> list[np.ndarray]:
    """Counts of pairs in random strings of each alphabet, and in dashed groups."""
    rng = np.random.default_rng(0)
    size = STRINGS * LENGTH
    samples = [np.frombuffer(a, np.uint8)[rng.integers(0, len(a), size)] for a in ALPHABETS]
    dashed = samples[0].reshape(STRINGS, LENGTH).copy()
    dashed[:, [8, 13, 18, 23]] = ord("-")
    starts = np.arange(STRINGS) * LENGTH
    ends = [starts + LENGTH] * len(ALPHABETS) + [starts + 36]
    return [
        np.bincount(_pairs(x, starts, e), minlength=N * N).reshape(N, N)
        for x, e in zip([*samples, dashed.ravel()], ends)
    ]


def _in_order() -> np.ndarray:
    """Counts of pairs where each character follows in order, or repeats."""
    counts = np.ones((N, N))
    for group in (range(1, 27), range(27, 53), range(53, 63)):
        for code in group:
            counts[code, code] = counts[code, min(code + 1, group[-1])] = 1_000
    counts[1:, [1, 27, 53]] += 100
    return counts


def models(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of all models (models x N x N), those of random strings first.

    ``counts`` has the corpus's pairs of characters in the patterns' values and in other runs. Secrets
    that no pattern finds are among the latter, so rare characters lean the more on the single ones.
    """
    secrets, others = counts.reshape(2, N, N)
    upper = np.arange(N)
    upper[1:27] += 26
    shouted = np.zeros((N, N))
    np.add.at(shouted, (upper[:, None], upper[None, :]), others)
    return np.stack(
        [
            _chain(secrets, 20.0, SMOOTH[0]),
            *(_chain(x, 20.0, DRAWN_SMOOTH) for x in _drawn()),
            _chain(others, 5000.0, SMOOTH[1]),
            _chain(shouted, 5000.0, SMOOTH[1]),
            _chain(_in_order(), 0.0, DRAWN_SMOOTH),
        ]
    )


def fit(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The models, from counts over all texts.

    The counts are a table of two times N * N numbers, whatever the corpus.
    """
    rows = docs.select(F.col(text).alias("text")).mapInArrow(_count, "model int, pair int, n long")
    counts = np.zeros((2, N * N))
    for row in rows.groupBy("model", "pair").agg(F.sum("n").alias("n")).collect():
        counts[row.model, row.pair] = row.n
    return models(counts)


def _random(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chains: np.ndarray) -> np.ndarray:
    """Which runs are random strings by the log-likelihood ratio."""
    flat = chains.reshape(len(chains), -1)
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    at = np.flatnonzero(letters[ends] > letters[starts])
    # No ratio exceeds the sum over characters of the best random model against the corpus's identifiers.
    most = flat[:SECRET_MODELS].max(0) - flat[SECRET_MODELS]
    for bounds in (most[None], flat):
        if not len(at):
            break
        sizes = ends[at] - starts[at]
        pairs = _pairs(data, starts[at], ends[at])
        before = np.cumsum(sizes) - sizes
        sums = np.stack([np.add.reduceat(x[pairs], before) for x in bounds])
        ratio = sums[0] if len(bounds) == 1 else sums[:SECRET_MODELS].max(0) - sums[SECRET_MODELS:].max(0)
        at = at[(ratio >= RATIO) & (ratio >= MEAN_RATIO * sizes)]
    found = np.zeros(len(starts), bool)
    found[at] = True
    return found


def all_spans(
    data: np.ndarray, offsets: np.ndarray, chains: np.ndarray
) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the patterns' and the models' spans, sorted."""
    spans = pattern_spans(data, offsets)
    starts, ends = _key_runs(data, offsets)
    free = ~_covered(spans, starts, ends)
    starts, ends = starts[free], ends[free]
    secret = _random(data, starts, ends, chains)
    found = [s[:3] for s in spans]
    found += [(a, 3, b) for a, b in zip(starts[secret].tolist(), ends[secret].tolist())]
    return sorted(found)


def scan(docs: DataFrame, chains: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): the spans of each text by start, then kind in the order of ``KINDS``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            found = all_spans(data, offsets, chains)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            rows: list[list[dict]] = [[] for _ in range(len(batch))]
            for start, kind, end in found:
                row = int(np.searchsorted(offsets, start, side="right")) - 1
                base = points[offsets[row]]
                rows[row].append(
                    {
                        "kind": KINDS[kind],
                        "start": int(points[start] - base),
                        "end": int(points[end] - base),
                    }
                )
            kind = pa.list_(
                pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(rows, kind)], names=["id", "spans"]
            )

    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    found = docs.mapInArrow(run, f"id {kind}, spans {SPANS}")
    return found.select(F.col("id").alias(key), "spans")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


def redact(
    docs: DataFrame, chains: np.ndarray, text: str = "text", mark: str = "[secret]"
) -> DataFrame:
    """The same rows and columns, each secret in the text replaced by ``mark``; overlapping ones by one."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            column = batch.column(text)
            data, offsets = text_bytes(column)
            texts: dict[int, list[tuple[int, int]]] = {}
            for start, _, end in all_spans(data, offsets, chains):
                spans = texts.setdefault(int(np.searchsorted(offsets, start, side="right")) - 1, [])
                if spans and start < spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(end, spans[-1][1]))
                else:
                    spans.append((start, end))
            values = column.to_pylist()
            for row, spans in texts.items():
                parts, at = [], int(offsets[row])
                for start, end in spans:
                    parts += [data[at:start].tobytes(), mark.encode()]
                    at = end
                values[row] = b"".join([*parts, data[at : offsets[row + 1]].tobytes()]).decode()
            at = batch.schema.get_field_index(text)
            yield batch.set_column(at, text, pa.array(values, column.type))

    return docs.mapInArrow(run, docs.schema)
