"""Near duplicates by word shingles: an exact Jaccard join on token-combination prefixes.

A document is the set of its distinct five-word shingles (its tokens). Tokens are ordered by how
frequent they are, rare ones first. A set of n tokens has a partner only if at most n // 4 of them
are missing there, so two partners share a token among the first n // 4 + 1 of each. Rare tokens are
indexed by themselves. Frequent tokens are dealt into groups and indexed by pairs within a group: if
no pair is shared, all but one token of the group are missing, so a group of c tokens stands for
c - 1, and the prefix is extended until it stands for n // 4 + 1. Group numbers depend on the size
band; a set is indexed under its own band and the next, which partners have in common. Sets under
``SMALL`` tokens have single tokens only.

1. A fixed-size sketch of all tokens says which are frequent; it errs only towards frequent, which
   costs work but loses nothing.
2. The prefix is extended by an eighth of the set, so partners share more than one of its tokens.
   Rare tokens meet, packed into buckets by their hash: those of a single document go, and the
   others learn in how many documents they are. A document that shares too few is done with. All
   tokens of those that are left meet once more, and these documents keep as few of their shared
   tokens as they must, the rarest. Tokens that are not shared
   bound the overlap with any partner, and with it the size of partners: many documents can only
   be the larger one of a pair, and two of them are never compared.
3. In each bucket of the index the document with the fewest tokens that no other has, its pivot, is
   compared with the others. Of the components that these links make, only documents that a bucket
   holds outside its pivot's are compared further: by bitmaps first, in which each token flips one
   bit, so that the bits in which two differ are a lower bound of the tokens that only one of them
   has. Each is verified with the nearest document of another component, and then with all others
   that the bound leaves. So every pair that could still join two components is verified or ruled
   out, and no pair within a component. Texts are read only for pairs that the bitmaps leave.

Documents with the same set are one node. Rows of one id are one document: different texts of an id are
compared each by itself, under a 64-bit hash of the id and the text, and their links are the id's. A null
id has no component and is linked with nothing. Empty or null texts, or those without words, have no tokens and no links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.arrow import WORDS_BYTES, binaries, pieces, small_batches, text_bytes
from rillhouse.llm.components import components
from rillhouse.llm.sieve import sieve, sifted, without
from rillhouse.llm.sketch import classes_of, frequency_classes
from rillhouse.llm.tables import written
from rillhouse.llm.words import mix, shingles_of, words_of

SHINGLE = 5
#: A token is frequent if its counter is this far above the mean, in standard deviations and counts.
SIGMAS, LEAST = 6.0, 64
#: Sets smaller than this are indexed by single tokens, up to 4/3 of it by both schemes.
SMALL = 12
#: Tokens of a group, about, and the share of a set that extends the prefix.
GROUP, EXTRA = 16, 8
#: Tokens that one task sorts to find the shared ones, about.
BUCKET = 500_000
#: Partners that one task compares with a document.
PARTNERS = 256
#: Documents of one bucket that one task holds to compare others with, about, and bits of a bitmap.
BLOCK, BITS = 1024, 1024


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order of their hash, and their number."""
    data, offsets = text_bytes(batch.column("text"))
    return shingles_of(words_of(data, offsets, lower=True), SHINGLE)


def _hashes(batch: pa.RecordBatch) -> np.ndarray:
    return _tokens(batch)[0]


def _pair_keys(tokens: np.ndarray, groups: np.ndarray, band: int) -> np.ndarray:
    """Keys of all pairs of tokens in one group; a key names its band."""
    order = np.lexsort((tokens, groups))
    tokens, groups = tokens[order], groups[order]
    found = []
    for some in np.split(tokens, np.flatnonzero(np.diff(groups)) + 1):
        i, j = np.triu_indices(len(some), 1)
        found.append(mix(some[i] * np.uint64(0x9E3779B97F4A7C15) + mix(some[j] + np.uint64(band))))
    return np.concatenate(found) | np.uint64(1)


def index_keys(
    tokens: np.ndarray, classes: np.ndarray, whole: bool = False
) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys under which a set is indexed: of rare tokens, and all others; and whether the rare ones do.

    ``whole`` gives all rare tokens instead of a prefix.

    A set of too few rare tokens has all of them, and pairs of frequent ones for the rest of its prefix.
    Keys of single tokens are even, keys of pairs odd. ``classes`` has the tokens' classes.
    """
    n = len(tokens)
    need = n // 4 + 1
    order = np.lexsort((tokens, classes))
    rare = int((classes == 0).sum())
    single = tokens & ~np.uint64(1)
    if n < SMALL:
        return single[order[: rare if whole else min(need, rare)]], single[order[rare:need]], need <= rare
    others = [single[order[rare:need]]] if 3 * n < 4 * SMALL else []
    extended = need if whole else need + n // EXTRA
    alone = extended <= rare
    if need > rare:
        rest = tokens[order[rare:]]
        band = int(np.log(n) / np.log(4 / 3) + 1e-9)
        for b in (band, band + 1):
            groups = (mix(rest + np.uint64(77)) % np.uint64(max(1, int((4 / 3) ** b) // GROUP))).astype(np.int64)
            first = np.zeros(len(rest), bool)
            first[np.unique(groups, return_index=True)[1]] = True
            stands_for = np.cumsum(~first)
            end = int(np.searchsorted(stands_for, need - rare)) + 1
            others.append(_pair_keys(rest[:end], groups[:end], b))
    rest = np.unique(np.concatenate(others)) if others else tokens[:0]
    return single[order[: extended if alone and not whole else rare]], rest, alone


def fewest(n: np.ndarray) -> np.ndarray:
    """Rare prefix tokens that a set of ``n`` tokens shares with any partner, if both have no others."""
    return np.where(3 * n < 4 * SMALL, 1, 1 + (3 * n + 3) // 4 // EXTRA)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of tokens and two hashes of each set; the tag is passed on."""
    for batch in pieces(batches, size=WORDS_BYTES):
        tokens, counts = _tokens(batch)
        rows = np.repeat(np.arange(len(counts)), counts)
        spread = mix(tokens)
        one, two = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
        np.add.at(one, rows, spread)
        np.add.at(two, rows, mix(spread))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("tag"),
                pa.array(counts, pa.int64()),
                pa.array(one.view(np.int64)),
                pa.array(two.view(np.int64)),
            ],
            names=["id", "tag", "n", "set1", "set2"],
        )


SETS = "id long, tag long, n long, set1 long, set2 long"
PACKED = "bucket long, rare boolean, keys binary, ids binary, sizes binary, tried binary"
SHARED = "id long, key long, held long, n long, tried long, alone boolean"
#: Stands for the number of documents of keys that were not counted.
_MANY = 1 << 40


def _pack(classes: np.ndarray, buckets: int, whole: bool):
    """Keys, ids, set sizes and numbers of rare keys of a piece of texts, packed by bucket.

    The number is negative, and less by one, for sets that have other keys as well.
    Rare tokens are dealt by key, to meet; the other keys by document, as they need not meet yet.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ids, counts = batch.column("id").to_numpy(), []
            kinds: tuple[list, list] = ([], [])
            for some in pieces([batch], size=WORDS_BYTES):
                tokens, number = _tokens(some)
                ends = np.cumsum(number)
                class_of = classes_of(tokens, classes)
                for row, (start, end) in enumerate(zip((ends - number).tolist(), ends.tolist()), sum(map(len, counts))):
                    if start < end:
                        rare, others, alone = index_keys(tokens[start:end], class_of[start:end], whole)
                        tried = len(rare) if alone else -len(rare) - 1
                        for kind, keys in zip(kinds, (rare, others)):
                            kind.append((keys, np.full(len(keys), row), np.full(len(keys), tried, np.int32)))
                counts.append(number)
            counts = np.concatenate(counts)
            for is_rare, kind in zip((True, False), kinds):
                if not kind:
                    continue
                keys, rows, tried = (np.concatenate(x) for x in zip(*kind))
                dealt = mix(keys.copy()) if is_rare else mix(ids[rows].view(np.uint64).copy())
                bucket = (dealt % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((keys, bucket))
                cuts = np.flatnonzero(np.diff(bucket[order])) + 1
                for some in np.split(order, cuts):
                    if len(some):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "bucket": pa.array([int(bucket[some[0]])], pa.int64()),
                                "rare": [is_rare],
                                "keys": [keys[some].tobytes()],
                                "ids": [ids[rows[some]].tobytes()],
                                "sizes": [counts[rows[some]].astype(np.uint32).tobytes()],
                                "tried": [tried[some].tobytes()],
                            }
                        )

    return run


def _meet(table: pa.Table) -> pa.Table:
    """The keys of a bucket that several documents have, with their number; other kinds pass."""
    parts = []
    for is_rare in (True, False):
        some = table.filter(pa.compute.equal(table.column("rare"), is_rare))
        kinds = (("keys", np.uint64), ("ids", np.int64), ("sizes", np.uint32), ("tried", np.int32))
        # Straight from the column's buffers: no further copy of a bucket as Python values.
        keys, ids, sizes, tried = (
            np.concatenate([np.empty(0, np.uint8), *(text_bytes(x)[0] for x in some.column(c).chunks)]).view(kind)
            for c, kind in kinds
        )
        held = np.full(len(keys), _MANY)
        if is_rare:
            order = np.lexsort((ids, keys))
            keys, ids, sizes, tried = keys[order], ids[order], sizes[order], tried[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            first = np.flatnonzero(new)
            # Documents of a key: rows of one id count once.
            other = new.copy()
            other[1:] |= ids[1:] != ids[:-1]
            number = np.add.reduceat(other, first) if len(first) else first
            held = np.repeat(number, np.diff(np.append(first, len(keys))))
            keep = held > 1
            keys, ids, sizes, tried, held = keys[keep], ids[keep], sizes[keep], tried[keep], held[keep]
        parts.append(
            pa.table(
                {
                    "id": pa.array(ids),
                    "key": pa.array(keys.view(np.int64)),
                    "held": pa.array(held, pa.int64()),
                    "n": pa.array(sizes.astype(np.int64)),
                    "tried": pa.array(np.where(tried < 0, -tried - 1, tried).astype(np.int64)),
                    "alone": pa.array(tried >= 0),
                }
            )
        )
    return pa.concat_tables(parts)


def _selected(shared: DataFrame, whole: bool) -> DataFrame:
    """(key, id, n, most, missing) of the documents that may have partners, under as few keys as they need.

    A document indexed by rare tokens alone needs its rarest shared ones. Of a prefix, it shares at
    least ``fewest`` with any partner: all but that many and one suffice. Of its ``whole`` rare
    tokens, n // 4 may be missing, and those that are not shared are. Others keep all their keys.
    ``missing`` counts the tokens that are not shared, and ``most`` is the size of the largest
    partner: an overlap of n less ``missing`` allows no more.
    """
    least = F.when(3 * F.col("n") < 4 * SMALL, 1).otherwise(
        1 + F.floor(F.floor((3 * F.col("n") + 3) / 4) / EXTRA)
    )
    keys = F.array_sort(F.collect_set(F.struct("held", "key")))
    by_set = shared.groupBy("id", "n", "tried", "alone").agg(keys.alias("keys"))
    used = F.size(F.filter("keys", lambda k: k["held"] < _MANY))
    missing = F.greatest(F.col("tried") - used, F.lit(0))
    needed = F.floor(F.col("n") / 4) + 1 - missing if whole else F.size("keys") - least + 1
    kept = F.when(F.col("alone"), needed).when(missing > F.floor(F.col("n") / 4), 0)
    kept = kept.otherwise(F.size("keys")).cast("int")
    by_set = by_set.select(
        "id",
        "n",
        "keys",
        kept.alias("kept"),
        F.floor((7 * (F.col("n") - missing) - 3 * F.col("n")) / 3).alias("most"),
        missing.alias("missing"),
    )
    by_set = by_set.where("kept > 0 and 4 * most >= 3 * n")
    some = F.explode(F.slice("keys", F.lit(1), F.col("kept")))
    return by_set.select("id", "n", "most", "missing", some.alias("k")).select("k.key", "id", "n", "most", "missing")


def _compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links among rows sorted by (a, salt, b): the rows without b have the texts of a."""
    current, sets = None, []
    for batch in pieces(batches, size=WORDS_BYTES):
        tokens, counts = _tokens(batch)
        ends = np.cumsum(counts)
        found = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")))
        for row, (a, salt, b) in enumerate(rows):
            some = tokens[ends[row] - counts[row] : ends[row]].copy()
            if b is None:
                sets = [*sets, some] if current == (a, salt) else [some]
                current = (a, salt)
                continue
            for mine in sets if current == (a, salt) and len(some) else []:
                at = np.minimum(np.searchsorted(mine, some), len(mine) - 1)
                both = int((mine[at] == some).sum())
                if 100 * both >= 75 * (len(mine) + len(some) - both):
                    found.append((a, b))
                    break
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"]
        )


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have at least the similarity.

    The partners of a document are dealt over tasks, ``PARTNERS`` to one; each task reads the
    document once and its partners one after another.
    """
    pairs = written(pairs, "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = texts.join(wanted, "id", "left_semi")
    spread = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("salts"))
    dealt = pairs.join(spread, "a").select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    theirs = dealt.join(few.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text")
    mine = dealt.select("a", "salt").distinct().join(few.withColumnRenamed("id", "a"), "a")
    rows = theirs.unionByName(mine.select("a", "salt", F.lit(None).cast("long").alias("b"), "text"))
    ordered = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "b")
    return ordered.mapInArrow(_compare, "a long, b long")


_MEMBER = "struct(id, low, high, most)"


def _pairs_of(rows: DataFrame) -> DataFrame:
    """Distinct (a, b) of the documents x and y of each row, if their sizes allow the similarity."""
    fits = (
        "4 * x.high >= 3 * y.low and 4 * y.high >= 3 * x.low and x.low <= y.most and y.low <= x.most"
    )
    return rows.where(fits).selectExpr("least(x.id, y.id) as a", "greatest(x.id, y.id) as b").distinct()


def _star(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """The documents x of each bucket beside its pivot y.

    The pivot is the document with the fewest tokens that no other has: near copies of a text are
    closest to the one with the fewest changes. All buckets order documents alike, so those of one
    group of copies mostly agree on the pivot, and its pairs are the same there.
    """
    pivot = F.min_by(F.expr(_MEMBER), F.struct("missing", "id")).alias("y")
    pivots = pivots.where("most >= low").groupBy("key").agg(pivot)
    return rows.join(pivots, "key").where("id != y.id").withColumn("x", F.expr(_MEMBER))


def _mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """The documents of buckets that hold some outside the component of their pivot, the ``head``.

    ``c`` is the component, and ``outside`` says that it is not the pivot's.
    """
    label = components(links)
    rows = members.join(label.toDF("id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    rows = rows.join(label.toDF("head", "home"), "head", "left")
    rows = rows.withColumn("outside", F.col("c") != F.coalesce("home", "head")).drop("home")
    rows = written(rows, "labelled")
    return rows.join(rows.where("outside").select("key").distinct(), "key", "left_semi")


def _parities(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bitmap of each text, in which each token flips one bit."""
    for batch in pieces(batches, size=WORDS_BYTES):
        tokens, counts = _tokens(batch)
        at = (tokens >> np.uint64(20)) % np.uint64(BITS)
        word = np.repeat(np.arange(len(counts)) * (BITS // 64), counts) + (at >> np.uint64(6)).astype(np.int64)
        found = np.zeros(len(counts) * (BITS // 64), np.uint64)
        np.bitwise_xor.at(found, word, np.uint64(1) << (at & np.uint64(63)))
        flips = binaries(found, np.full(len(counts), BITS // 64)).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), flips], names=["id", "bits"])


def differences(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least number of tokens that only one of two texts has, by the bitmaps of each x and y."""
    return np.bitwise_count(x[:, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)


def _close(nearest: bool):
    """Pairs of a block of outside documents and members of their bucket that may be similar.

    Rows come by bucket and block, the outside documents first. Texts of n and m tokens are similar
    only if at most (n + m) / 7 tokens are in just one of them. With ``nearest``, each outside
    document has only its nearest such member, of equals the least.
    """
    columns = ("id", "low", "high", "most", "c")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, best = None, [], None

        def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"]
            )

        def finished() -> Iterator[pa.RecordBatch]:
            if best is not None:
                some = best[0] < _MANY
                yield found(block[0]["id"][some], best[1][some])

        for batch in batches:
            if not len(batch):
                continue
            rows = {c: batch.column(c).to_numpy() for c in columns}
            data, _ = text_bytes(batch.column("bits"))
            rows["bits"] = data.reshape(len(batch), -1).view(np.uint64)
            key, salt = batch.column("key").to_numpy(), batch.column("salt").to_numpy()
            member = batch.column("member").to_numpy(zero_copy_only=False)
            new = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (member[1:] != member[:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(batch)]
            for start, end in zip(cuts, cuts[1:]):
                group = (key[start], salt[start])
                if group != current:
                    yield from finished()
                    current, block, best = group, [], None
                some = {c: v[start:end] for c, v in rows.items()}
                if not member[start]:
                    block.append(some)
                    continue
                if len(block) > 1:
                    block = [{c: np.concatenate([x[c] for x in block]) for c in some}]
                x = {c: v if c == "bits" else v[:, None] for c, v in block[0].items()}
                if nearest and best is None:
                    best = np.full(len(x["id"]), _MANY), np.zeros(len(x["id"]), np.int64)
                step = max(1, (1 << 16) // len(x["id"]))
                for at in range(0, end - start, step):
                    y = {c: v[at : at + step] for c, v in some.items()}
                    apart = differences(x["bits"], y["bits"])
                    fits = (x["c"] != y["c"]) & (7 * apart <= x["high"] + y["high"])
                    fits &= (4 * x["high"] >= 3 * y["low"]) & (4 * y["high"] >= 3 * x["low"])
                    fits &= (x["low"] <= y["most"]) & (y["low"] <= x["most"])
                    if not nearest:
                        i, j = np.nonzero(fits)
                        yield found(block[0]["id"][i], y["id"][j])
                        continue
                    apart[~fits] = _MANY
                    least = apart.min(1)
                    ids = np.where(apart == least[:, None], y["id"], np.iinfo(np.int64).max).min(1)
                    better = (least < best[0]) | ((least == best[0]) & (ids < best[1]))
                    best[0][better], best[1][better] = least[better], ids[better]
        yield from finished()

    return run


def _close_pairs(mixed: DataFrame, bits: DataFrame, nearest: bool) -> DataFrame:
    """Distinct pairs (a, b) of different components that bitmaps cannot tell apart.

    The outside documents of a bucket are dealt over blocks of ``BLOCK``, and each block meets all
    members of the bucket; one task holds one block and reads the members one after another.
    """
    blocks = mixed.where("outside").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = mixed.join(blocks, "key")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    mine = rows.where("outside").withColumn("salt", F.pmod(F.xxhash64("id"), "blocks"))
    theirs = rows.withColumn("salt", every)
    columns = "id", "key", "salt", "member", "low", "high", "most", "c"
    both = mine.withColumn("member", F.lit(False)).select(*columns)
    both = both.unionByName(theirs.withColumn("member", F.lit(True)).select(*columns)).join(bits, "id")
    ordered = both.repartition("key", "salt").sortWithinPartitions("key", "salt", "member")
    return ordered.mapInArrow(_close(nearest), "a long, b long").distinct()


def _links(bucket: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) that join all documents which some path of links joins."""
    star = written(_star(bucket, bucket), "stars")
    links = written(verified(_pairs_of(star), texts), "links")
    members = star.select("key", F.col("y.id").alias("head"), "id", "low", "high", "most")
    mixed = written(_mixed(members, links), "mixed")
    ids = written(mixed.select("id").distinct(), "mixed-ids")
    some = texts.join(ids, "id", "left_semi")
    bits = written(some.mapInArrow(_parities, "id long, bits binary"), "bits")
    near = verified(_close_pairs(mixed, bits, nearest=True), texts)
    links = written(links.unionByName(near), "links")
    mixed = written(_mixed(mixed.drop("c", "outside"), links), "mixed")
    return links.unionByName(verified(_close_pairs(mixed, bits, nearest=False), texts))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of each row; the key is a 64-bit integer."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    classes, total = frequency_classes(texts, _hashes, SIGMAS, LEAST)
    tag = F.xxhash64("id", "text").alias("tag")
    light = written(texts.select("id", "text", tag).mapInArrow(_sets, SETS), "sets")
    known = light.where("id is not null and n > 0")
    # Texts of an id that has several go by their tags from here on.
    tags = F.min("tag").alias("least"), F.max("tag").alias("most")
    several = light.where("id is not null").groupBy("id").agg(*tags).where("least < most")
    several = written(several.select("id"), "several")
    repeated = not several.isEmpty()
    if repeated:
        owners = written(light.join(several, "id").select("tag", F.col("id").alias("owner")).distinct(), "owners")
        bitmap = sieve(several, "id")

        def by_tag(rows: DataFrame) -> DataFrame:
            """The rows, the tag in place of each id that has several texts."""
            its = F.when(F.col("owner").isNotNull(), F.col("tag")).otherwise(F.col("id")).alias("id")
            columns = [its if c == "id" else F.col(c) for c in rows.columns if c != "tag"]
            some = several.select("id", F.col("id").alias("owner"))
            suspects = sifted(rows, "id", bitmap).join(some, "id", "left").select(*columns)
            return sifted(rows, "id", bitmap, out=True).drop("tag").unionByName(suspects)

        known = by_tag(known)
        texts = by_tag(texts.select("id", "text", tag))
    # The least document that has the same set stands for all of them.
    same = known.groupBy("set1", "set2").agg(F.min("id").alias("node"))
    nodes = written(known.join(same, ["set1", "set2"]).select("id", "node").distinct(), "nodes")

    buckets = max(1, total * 3 // 8 // BUCKET)

    def index_of(some: DataFrame, whole: bool) -> DataFrame:
        packed = some.mapInArrow(_pack(classes, buckets, whole), PACKED)
        shared = packed.groupBy("bucket").applyInArrow(_meet, SHARED)
        return _selected(shared, whole)

    alive = index_of(texts.where("id is not null"), whole=False).select("id").distinct()
    alive = written(alive.join(nodes.where("id = node").select("id"), "id", "left_semi"), "alive")
    few = sifted(texts, "id", sieve(alive, "id")).join(alive, "id", "left_semi")
    few = written(few.distinct(), "texts")
    index = index_of(few, whole=True)
    bucket = index.groupBy("key", "id").agg(
        F.min("n").alias("low"),
        F.max("n").alias("high"),
        F.max("most").alias("most"),
        F.min("missing").alias("missing"),
    )
    links = _links(written(bucket, "buckets"), few)
    equal = nodes.where("id != node").select(F.col("node").alias("a"), F.col("id").alias("b"))
    links = links.unionByName(equal)
    if repeated:
        for end in ("a", "b"):
            owner = owners.withColumnRenamed("tag", end)
            other = "b" if end == "a" else "a"
            links = links.join(owner, end, "left").select(F.coalesce("owner", end).alias(end), other)
    label = components(links)
    label = label.withColumnRenamed("node", "id")
    return light.join(label, "id", "left").select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the least document of each component, and those without an id.

    Of several rows with that id the least stays, by the columns in order.
    """
    found = near_duplicates(docs, key, text)
    copies = written(found.where(F.col("component_id") != F.col(key)).select(key).distinct(), "copies")
    again = docs.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    again = written(again.join(copies, key, "left_anti"), "repeated")
    # One pass for both kinds of ids: each sieve after another holds a further Python worker.
    single = without(docs, copies.unionByName(again), key)
    row = F.min(F.struct(*(F.col(c) for c in docs.columns))).alias("row")
    several = docs.join(again, key, "left_semi").groupBy(key).agg(row).select("row.*")
    return single.unionByName(several.select(*docs.columns))
