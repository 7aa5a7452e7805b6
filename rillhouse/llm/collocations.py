"""Phrases of two to five words that occur more often than their parts explain, by direct-address tiling.

A-Z is lower-cased, texts are cut at ``. , ; : ! ?`` and line breaks into pieces, and those at spaces
and tabs into words; phrases lie within a piece. Everything is counted for each language.

Words of at least ``LEAST`` occurrences are numbered by falling frequency, and texts become number
sequences. A pair of neighbours is a cell of a square tile of 256 by 256 numbers; tasks count the
cells of a well-filled tile with a dense ``bincount`` and the others as sorted coordinates, and the
counts of a cell meet in a shuffle. Pairs of at least ``LEAST`` occurrences are numbered by falling
frequency in turn, and paired with the word behind them: so three words are counted, then four, then
five. A longer phrase is only looked for where its first and its last words are a frequent phrase.

Numbers are given to the ``NUMBERED`` most frequent words and to as many phrases of each length,
which bounds what is broadcast. Where there are more, phrases that need a missing number are counted
by their text, in the plain way; a bitmap of fixed size keeps out most that cannot be frequent.

* Null and empty texts have no words. A null language is ``und``, as is the language of that name.
* A text of any length is read as a whole; equal rows count each.
* Ties are settled by score, occurrences and the phrase's bytes, which differ within a language.
* An empty table gives an empty table. Further columns are ignored, whatever their names.

Words are told apart by 64-bit hashes in the number sequences; occurrences and scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillhouse.llm.arrow import pieces, small_batches, text_bytes
from rillhouse.llm.sieve import BITS
from rillhouse.llm.tables import written
from rillhouse.llm.words import mix, window_hashes, words_of
from rillhouse.operators.skew import lookup_join

#: Occurrences from which a phrase is frequent.
LEAST = 100
#: Words of the longest phrase.
LONGEST = 5
#: Phrases of a language in the report.
TOP = 2000
#: Words, and phrases of each length, that get a number.
NUMBERED = 1 << 20
#: Bits of a number, and of its place within its tile.
NUMBER_BITS, SIDE = 20, 8
CELLS = 1 << 2 * SIDE
#: Cells of a tile from which a batch of them is counted densely.
DENSE = CELLS // 16
#: Dense tiles that a task keeps at once, pairs it gathers before it counts them, and counts that leave together.
KEPT_TILES = 64
PAIRS = 1 << 19
LEAVING = 1 << 16
_TEXT_BYTES = 1 << 20

_AS_SPACE = np.arange(256, dtype=np.uint8)
_AS_SPACE[list(b".,;:!?")] = 32
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Tokens:
    """Words of several texts: their bytes, hashes, texts, and whether each starts a piece."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    rows: np.ndarray
    fresh: np.ndarray

    def text(self, first: int, last: int) -> bytes:
        """The words from ``first`` to ``last``, joined by a space."""
        words = (self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(first, last + 1))
        return b" ".join(words)

    def words(self, at: np.ndarray) -> list[bytes]:
        """The words at some positions."""
        data = self.data.tobytes()
        return [data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist())]


def tokens_of(column: pa.Array) -> Tokens:
    """The words of a text column."""
    data, offsets = text_bytes(column)
    words = words_of(_AS_SPACE[data], offsets, lower=True)
    rows = words.rows
    breaks = np.searchsorted(np.flatnonzero(_BREAK[data]), words.starts)
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (breaks[1:] != breaks[:-1]) | (rows[1:] != rows[:-1])
    return Tokens(_LOWER[data], words.starts, words.ends, words.hashes, rows, fresh)


def _langs(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    """The languages of a batch and the place of each row's."""
    found = batch.column("lang").dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(zero_copy_only=False)


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    known = F.coalesce(F.col(lang).cast("string"), F.lit("und"))
    return docs.select(known.alias("lang"), F.col(text).alias("text"))


# --- words ----------------------------------------------------------------------------


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, size=_TEXT_BYTES):
        tokens = tokens_of(batch.column("text"))
        names, langs = _langs(batch)
        langs = langs[tokens.rows]
        for place, name in enumerate(names):
            its = np.flatnonzero(langs == place)
            _, at, counts = np.unique(tokens.hashes[its], return_index=True, return_counts=True)
            words = tokens.words(its[at])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(words), pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts)],
                names=["lang", "phrase", "n"],
            )


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, a): the words of each language and how often they occur."""
    counted = texts.mapInArrow(_count_words, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("a"))


# --- numbers --------------------------------------------------------------------------


@dataclass
class Numbers:
    """Numbers of the words, or of the phrases of one length, by language: sorted keys and their numbers.

    The key of a word is its hash; that of a longer phrase holds the number of all but its last
    word and the number of that. ``whole`` tells that no frequent one is without a number; ``langs``
    are the languages with a numbered word.
    """

    langs: list[str] = field(default_factory=list)
    keys: dict[str, np.ndarray] = field(default_factory=dict)
    numbers: dict[str, np.ndarray] = field(default_factory=dict)
    whole: bool = True

    def of(self, lang: str, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        known = self.keys.get(lang)
        if known is None or not len(keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, self.numbers[lang][at], -1)


#: Bits of a pair of numbers; those above hold the language's place.
_PAIR = (1 << 2 * NUMBER_BITS) - 1


def _pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return one << NUMBER_BITS | two


def _numbered(found: DataFrame, words: Numbers | None, limit: int) -> tuple[Numbers, DataFrame]:
    """Numbers for the most frequent rows, and (place, lang, number, phrase) as a table.

    At most ``limit`` rows reach the driver, whatever the corpus.
    """
    spark = found.sparkSession
    # Eighths of a doubling: the highest ones that hold at most ``limit`` rows together.
    height = F.floor(8 * F.log2("a"))
    held, lowest = 0, None
    for row in found.groupBy(height.alias("height")).count().orderBy(F.desc("height")).collect():
        held += row["count"]
        if held > limit:
            break
        lowest = row.height
    numbers = Numbers(whole=held <= limit)
    first = found.where(height >= lowest) if lowest is not None else found.where("false")
    if limit > 1 << NUMBER_BITS:
        raise ValueError(f"at most {1 << NUMBER_BITS} numbers")
    rows = first.select("lang", "phrase", "a", *(["pair"] if words else [])).toArrow().combine_chunks()
    rows = rows.sort_by([("a", "descending"), ("lang", "ascending"), ("phrase", "ascending")])
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    place = langs.indices.to_numpy(zero_copy_only=False)
    rank = np.zeros(len(rows), np.int64)
    numbers.langs = langs.dictionary.to_pylist() if words is None else words.langs
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        its = np.flatnonzero(place == i)
        rank[its] = np.arange(len(its))
        if words is not None:
            keys = rows.column("pair").to_numpy()[its] & _PAIR
        else:
            data, offsets = text_bytes(rows.column("phrase").combine_chunks().take(pa.array(its)))
            keys = words_of(data, offsets, lower=True).hashes
        order = np.argsort(keys)
        numbers.keys[lang], numbers.numbers[lang] = keys[order], rank[its][order]
    places = np.array([numbers.langs.index(lang) for lang in langs.dictionary.to_pylist()], np.int64)
    table = {"place": places[place], "lang": rows.column("lang"), "number": rank, "phrase": rows.column("phrase")}
    columns = "place long, lang string, number long, phrase string"
    frame = spark.createDataFrame(pa.table(table)) if len(rows) else spark.createDataFrame([], columns)
    return numbers, written(frame, "numbers")


def _chain(lang: str, ids: np.ndarray, levels: list[Numbers], words: int) -> np.ndarray:
    """The number of the phrase of ``words`` words that starts at each position, or -1."""
    phrase = ids
    for size in range(2, words + 1):
        pair = np.full(max(len(ids) - size + 1, 0), -1, np.int64)
        whole = np.flatnonzero((phrase[:-1] >= 0) & (phrase[1:] >= 0))
        pair[whole] = levels[size - 2].of(lang, _pair(phrase[whole], ids[whole + size - 1]))
        phrase = pair
    return phrase


def _encode(words: Numbers, docs: DataFrame) -> DataFrame:
    """(lang, ids): the words' numbers, -1 for a word without one and between pieces."""
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, size=_TEXT_BYTES):
            tokens = tokens_of(batch.column("text"))
            names, langs = _langs(batch)
            langs = langs[tokens.rows]
            for place, name in enumerate(names):
                its = np.flatnonzero(langs == place)
                if not len(its):
                    continue
                at = np.arange(len(its)) + np.cumsum(tokens.fresh[its])
                ids = np.full(at[-1] + 1, -1, np.int32)
                ids[at] = shared.value.of(name, tokens.hashes[its])
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([name], pa.string()), "ids": pa.array([ids.tobytes()], pa.binary())}
                )

    return docs.mapInArrow(run, "lang string, ids binary")


# --- tiles ----------------------------------------------------------------------------


_LOW = (1 << SIDE) - 1
_TILE_BITS = NUMBER_BITS - SIDE


def _code(place: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Language, tile and cell of each pair, in this order of bits."""
    tile = place << 2 * _TILE_BITS | one >> SIDE << _TILE_BITS | two >> SIDE
    return tile << 2 * SIDE | (one & _LOW) << SIDE | two & _LOW


def _counts(codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted codes as rows of a language's place, a pair and its count, ``LEAVING`` at a time."""
    for start in range(0, len(codes), LEAVING):
        some = codes[start : start + LEAVING]
        tile = some >> 2 * SIDE
        one = (tile >> _TILE_BITS & (1 << _TILE_BITS) - 1) << SIDE | some >> SIDE & _LOW
        two = (tile & (1 << _TILE_BITS) - 1) << SIDE | some & _LOW
        pair = (tile >> 2 * _TILE_BITS) << 2 * NUMBER_BITS | _pair(one, two)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(counts[start : start + LEAVING])], names=["pair", "n"])


class Tiles:
    """Counts of pairs of numbers, tile by tile, that leave as rows of a pair and its count."""

    def __init__(self) -> None:
        self.dense: dict[int, np.ndarray] = {}
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, place: int, one: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Takes in pairs of a language; their numbers are below 2 to the power ``NUMBER_BITS``."""
        for start in range(0, len(one), PAIRS):
            self.waiting.append(_code(place, one[start : start + PAIRS], two[start : start + PAIRS]))
            self.size += len(self.waiting[-1])
            if self.size >= PAIRS:
                yield from self._count()

    def _count(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        codes = np.concatenate(self.waiting)
        self.waiting, self.size = [], 0
        codes.sort()
        tiles = codes >> 2 * SIDE
        starts = np.flatnonzero(np.r_[True, tiles[1:] != tiles[:-1]])
        sizes = np.diff(np.append(starts, len(tiles)))
        full = sizes >= DENSE
        rest = np.ones(len(codes), bool)
        for start, size in zip(starts[full].tolist(), sizes[full].tolist()):
            tile = int(tiles[start])
            if tile not in self.dense and len(self.dense) == KEPT_TILES:
                continue
            counts = np.bincount(codes[start : start + size] & CELLS - 1, minlength=CELLS)
            self.dense[tile] = self.dense[tile] + counts if tile in self.dense else counts
            rest[start : start + size] = False
        codes = codes[rest]
        if len(codes):
            new = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            yield from _counts(codes[new], np.diff(np.append(new, len(codes))))

    def rest(self) -> Iterator[pa.RecordBatch]:
        """What has not left yet."""
        yield from self._count()
        for tile, counts in self.dense.items():
            cells = np.flatnonzero(counts)
            yield from _counts(tile << 2 * SIDE | cells, counts[cells])


def frequent_pairs(encoded: DataFrame, levels: list[Numbers], words: Numbers, least: int) -> DataFrame:
    """(pair, a): frequent phrases of one word more than the last level's.

    ``pair`` holds the place of the language, the number of all but the last word, and that of the
    last word.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((levels, words.langs))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, langs = shared.value
        tiles, size, places = Tiles(), len(levels) + 1, {lang: i for i, lang in enumerate(langs)}
        for batch in batches:
            for lang, ids in zip(batch.column("lang").to_pylist(), batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), np.int32).astype(np.int64)
                phrase = _chain(lang, ids, levels, size)
                at = np.flatnonzero((phrase[:-1] >= 0) & (phrase[1:] >= 0))
                if len(at):
                    yield from tiles.add(places[lang], phrase[at], ids[at + size])
        yield from tiles.rest()

    counted = encoded.mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("a"))
    return counted.where(F.col("a") >= least)


# --- phrases without numbers ------------------------------------------------------------


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of phrases, of fixed size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for batch in batches:
            tokens = tokens_of(batch.column("phrase"))
            if len(tokens.rows):
                first = np.searchsorted(tokens.rows, np.arange(len(batch) + 1))
                for name, a, b in zip(batch.column("lang").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                    bits[_places(name, window_hashes(tokens.hashes, np.array([a]), b - a))] = True
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": [np.packbits(bits).tobytes()]})

    whole = np.zeros(BITS // 8, np.uint8)
    parts = phrases.select("lang", "phrase").coalesce(16).mapInArrow(run, "bits binary")
    for row in parts.toLocalIterator():
        whole |= np.frombuffer(row.bits, np.uint8)
    return whole


def _places(lang: str, hashes: np.ndarray) -> np.ndarray:
    salt = np.frombuffer(lang.encode().ljust(8, b"\0")[:8], np.uint64)
    return (mix(hashes ^ mix(salt.copy())) % np.uint64(BITS)).astype(np.int64)


def _by_text(texts: DataFrame, words: Numbers, levels: list[Numbers], shorter: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a): frequent phrases of one word more that lack a number on the way."""
    shared = texts.sparkSession.sparkContext.broadcast((words, levels, _bitmap(shorter)))
    size = len(levels) + 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, levels, bitmap = shared.value
        for batch in pieces(batches):
            tokens = tokens_of(batch.column("text"))
            if len(tokens.rows) < size:
                continue
            names, langs = _langs(batch)
            langs = langs[tokens.rows]
            start = np.arange(len(langs) - size + 1)
            piece = np.cumsum(tokens.fresh)
            for place, name in enumerate(names):
                at = start[(piece[start] == piece[start + size - 1]) & (langs[start] == place)]
                part = window_hashes(tokens.hashes, np.arange(len(langs) - size + 2), size - 1)
                for shift in (0, 1):
                    bit = _places(name, part[at + shift])
                    at = at[(bitmap[bit >> 3] >> (7 - bit & 7).astype(np.uint8)) & 1 > 0]
                # Those with all numbers have been counted in tiles.
                ids = np.where(langs == place, words.of(name, tokens.hashes), -1)
                phrase = _chain(name, ids, levels, size - 1)
                at = at[(phrase[at] < 0) | (phrase[at + 1] < 0) | (ids[at + size - 1] < 0)]
                whole = window_hashes(tokens.hashes, at, size)
                _, first, counts = np.unique(whole, return_index=True, return_counts=True)
                found = [tokens.text(i, i + size - 1) for i in at[first].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(counts)],
                    names=["lang", "phrase", "n"],
                )

    counted = texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase")
    return counted.agg(F.sum("n").alias("a")).where(F.col("a") >= least)


# --- phrases --------------------------------------------------------------------------


def phrases(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, numbered: int = NUMBERED
) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, a) of the frequent phrases, single words too, (lang, n) of all words)."""
    small_batches(docs.sparkSession)
    texts = _texts(docs, lang, text)
    counts = written(word_counts(texts), "words")
    sizes = written(counts.groupBy("lang").agg(F.sum("a").alias("n")), "sizes")
    often = written(counts.where(F.col("a") >= least), "frequent-1")
    words, word_names = _numbered(often, None, numbered)
    encoded = written(_encode(words, texts), "encoded")
    names, levels, found, whole = word_names, [], often.select("lang", F.lit(1).alias("words"), "phrase", "a"), words.whole
    shorter = often
    for size in range(2, LONGEST + 1):
        pairs = frequent_pairs(encoded, levels, words, least)
        number = F.lit((1 << NUMBER_BITS) - 1)
        pairs = pairs.withColumns(
            {
                "place": F.shiftright("pair", 2 * NUMBER_BITS),
                "one": F.shiftright("pair", NUMBER_BITS).bitwiseAND(number),
                "two": F.col("pair").bitwiseAND(number),
            }
        )
        one = names.select("place", "lang", F.col("number").alias("one"), F.col("phrase").alias("_one"))
        two = word_names.select("place", F.col("number").alias("two"), F.col("phrase").alias("_two"))
        pairs = pairs.join(one, ["place", "one"]).join(two, ["place", "two"])
        phrase = F.concat_ws(" ", "_one", "_two").alias("phrase")
        pairs = written(pairs.select("lang", phrase, "a", "pair"), f"frequent-{size}")
        longer = pairs.select("lang", "phrase", "a")
        if not whole:
            rest = written(_by_text(texts, words, levels, shorter, least), f"rest-{size}")
            longer = longer.unionByName(rest.select("lang", "phrase", "a"))
        found = found.unionByName(longer.select("lang", F.lit(size).alias("words"), "phrase", "a"))
        if size < LONGEST:
            more, names = _numbered(pairs, words, numbered)
            levels, shorter, whole = [*levels, more], longer, whole and more.whole
    return written(found, "phrases"), sizes


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the phrases of several words, by their lowest-scoring cut."""
    split = found.where("words > 1").select("lang", "phrase", "a", "words", F.split("phrase", " ").alias("w"))
    cuts = split.select("lang", "phrase", "a", "words", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        _joined(F.expr("slice(w, 1, k)")).alias("left"),
        _joined(F.expr("slice(w, k + 1, words - k)")).alias("right"),
    )
    part = found.select("lang", "phrase", "a")
    for name, count in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part.toDF("lang", name, count), ["lang", name]).drop(name)
    cuts = lookup_join(cuts, sizes.toDF("_lang", "n"), ("lang", "_lang"), "inner")
    # Products may pass 64 bits: decimals of up to 38 digits, whose quotient is exact.
    a, n, l, r = (f"cast({c} as decimal(18, 0))" for c in "anlr")
    cuts = cuts.withColumn("score", F.expr(f"1000bd * {a} * {n} div ({l} * {r})"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def _inside(found: DataFrame) -> DataFrame:
    """(lang, phrase, a) of phrases that a frequent phrase of as many occurrences contains.

    If a phrase lies in a longer one that occurs as often, so does one longer by a word.
    """
    split = found.where("words > 2").select("lang", "a", F.split("phrase", " ").alias("w"), "words")
    ends = F.array(_joined(F.expr("slice(w, 1, words - 1)")), _joined(F.expr("slice(w, 2, words - 1)")))
    return split.select("lang", F.explode(ends).alias("phrase"), "a").distinct()


def _first(rows: DataFrame, groups: list[str], top: int) -> DataFrame:
    """The first rows of each group, with their ``rank``."""
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return rows.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def mine(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = LEAST,
    top: int = TOP,
    numbered: int = NUMBERED,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language."""
    found, sizes = phrases(docs, lang, text, least, numbered)
    rows = scored(found, sizes).join(_inside(found), ["lang", "phrase", "a"], "left_anti")
    # Parts of a language first, so that no task gets the best phrases of all tasks.
    parts = _first(rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64))), ["lang", "part"], top)
    best = _first(parts.drop("rank", "part"), ["lang"], top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
