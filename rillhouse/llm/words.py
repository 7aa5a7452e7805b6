"""Words, word hashes and shingles of whole texts, on the bytes of an Arrow column.

A word is a run of bytes other than space and ``\\t \\n \\v \\f \\r``; those bytes never occur inside
a longer UTF-8 character, so byte runs are the character runs ``[^\\x20\\x09-\\x0D]+``. Hashes have
64 bits and depend on nothing but the bytes, so all tasks agree on them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from rillhouse.llm.arrow import WORDS_BYTES

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.Generator(np.random.PCG64(20240501)).integers(
    1, 1 << 63, 256, dtype=np.uint64
) * np.uint64(2) + np.uint64(1)
_LOWER_BYTES = _BYTES.copy()
_LOWER_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(n - 1, WORDS_BYTES).bit_length()
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            table = np.empty(size, np.uint64)
            table[0] = 1
            done = 1
            while done < size:
                step = min(done, size - done)
                table[done : done + step] = table[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            tables.append(table)
        _powers[:] = tables
    return _powers


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` of each span, by differences of polynomial prefix sums."""
    power, inverse = _power_tables(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    spans = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(spans + (ends - starts).astype(np.uint64) * _ODD)


@dataclass
class Words:
    """Words of several texts: byte spans, hashes, and the first word of each text (n + 1 values)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words_of(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, cut: np.ndarray | None = None
) -> Words:
    """Words of the texts in ``data``; ``lower`` hashes A-Z as a-z, ``cut`` marks further starts.

    Works block by block, blocks cut at spaces, so that a long text costs little more than its words.
    """
    space = _SPACE[data]
    inside = ~space
    first = inside.copy()
    first[1:] &= space[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    if cut is not None:
        cuts = np.union1d(cuts, np.flatnonzero(cut))
    first[cuts] |= inside[cuts]
    last = inside
    last[:-1] &= space[1:]
    if len(cuts):
        last[cuts - 1] = ~space[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    table = _LOWER_BYTES if lower else _BYTES
    at = 0
    while at < len(starts):
        stop = max(int(np.searchsorted(ends, starts[at] + WORDS_BYTES)), at + 1)
        base = starts[at]
        block = table[data[base : ends[stop - 1]]]
        hashes[at:stop] = span_hashes(block, starts[at:stop] - base, ends[at:stop] - base)
        at = stop
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def window_starts(bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window of ``n`` consecutive words within one text, and the windows per text."""
    counts = np.maximum(np.diff(bounds) - n + 1, 0)
    before = np.cumsum(counts) - counts
    starts = np.arange(counts.sum()) + np.repeat(bounds[:-1] - before, counts)
    return starts, counts


def window_hashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each start."""
    if not len(starts):
        return np.empty(0, np.uint64)
    return span_hashes(hashes, starts, starts + n)


def shingles_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each text as sorted hashes, text after text, and their counts.

    A text of fewer words has its whole sequence as one shingle; one without words has none.
    """
    starts, counts = window_starts(words.bounds, n)
    total = words.counts
    short = np.flatnonzero((total > 0) & (total < n))
    rows = np.concatenate([np.repeat(np.arange(len(total)), counts), short])
    keys = np.concatenate(
        [
            window_hashes(words.hashes, starts, n),
            span_hashes(words.hashes, words.bounds[short], words.bounds[short + 1]),
        ]
    )
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return keys[new], np.bincount(rows[new], minlength=len(total))


def byte_span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each span."""
    return span_hashes(_BYTES[data], starts, ends)


def row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` over each of the rows that the offsets bound."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs again in its row, and whether it occurs earlier there.

    Keys are in the order of their rows; a 64-bit hash of both stands for the two.
    """
    keys = keys ^ mix(rows.astype(np.uint64) + _ODD)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    again, earlier = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    earlier[order[1:]] = same
    again[order[:-1]] |= same
    return again, earlier


def is_space(data: np.ndarray) -> np.ndarray:
    """Whether each byte separates words."""
    return _SPACE[data]
