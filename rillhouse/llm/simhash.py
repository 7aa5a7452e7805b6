"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A document's words (A-Z lower-cased, runs of bytes other than white space) give shingles of three
words, repeats included, joined by a space; fewer words give one shingle. A bit of the fingerprint
is set if it is set in more than half of the shingles' XXH64 hashes (seed 42).

Fingerprints of at most two different bits are linked. Two such fingerprints agree in two of their
four blocks of 16 bits, so every distinct fingerprint is put in six shards, one for each choice of
two blocks. A shard with more than ``HOT`` fingerprints is cut once more, by two of the four bytes of
the other two blocks: the 48 bits that such a shard agrees in leave at most 65,536 fingerprints. Each
shard has a BK-tree, whose nodes have their children keyed by the integer Hamming distance to them;
the shard's fingerprints descend it and follow only the edges within the radius of their own distance.

* Equal fingerprints are one node, however many documents have them.
* Null and empty texts, and those without a word, have the fingerprint zero, which links like any
  other. A very long text is read in blocks.
* Every row is judged by itself, also where an id has several rows. Rows without an id take part,
  and a component's id is its smallest one; it is null where no row of the component has an id.
* An empty table gives an empty table. Further columns are ignored, whatever their names.

A shard sends on only a spanning forest of what it linked: a star for each group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.components import components
from rillhouse.llm.tables import written
from rillhouse.operators.skew import find_hot_keys, skew_join

WORDS = 3
SEED = 42
#: Bits in which linked fingerprints may differ.
RADIUS = 2
#: Fingerprints of a shard from which it is cut once more.
HOT = 4096
#: Bytes of a text that are read at once.
BLOCK = 1 << 20
#: Fingerprints that descend a tree together.
QUERIES = 128
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_SPACES = b" \t\n\v\f\r"


# --- fingerprints ---------------------------------------------------------------------


def _blocks(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, block by block; a block ends between two words."""
    start = 0
    while start < len(text):
        end = min(start + BLOCK, len(text))
        while end < len(text) and text[end] not in _SPACES:
            end += 1
        yield text[start:end].translate(_LOWER).split()
        start = end


def _hashes(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of the shingles of ``n`` words."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[n - 1 :])], np.uint64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a text in UTF-8."""
    ones, count, tail = np.zeros(64, np.int64), 0, []
    for words in _blocks(text or b""):
        words = tail + words
        if len(words) >= WORDS:
            hashes = _hashes(words, WORDS)
            ones, count = ones + _ones(hashes), count + len(hashes)
            words = words[1 - WORDS :]
        tail = words
    if not count and tail:
        ones, count = _ones(_hashes(tail, len(tail))), 1
    bits = np.packbits(2 * ones > count, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little") if count else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fp) of each row; ``fp`` has the bits of the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


# --- BK-trees -------------------------------------------------------------------------


class Tree:
    """A BK-tree of distinct fingerprints.

    Nodes are stored by level; the children of a node lie side by side, by their ``edge``, the
    distance to it.
    """

    def __init__(self, values: np.ndarray):
        nodes, edges, parents = [values[:1]], [np.zeros(1, np.int64)], [np.full(1, -1)]
        rest, above, size = values[1:], np.zeros(max(len(values) - 1, 0), np.int64), 1
        at = values[:1]
        base = 0
        while len(rest):
            edge = np.bitwise_count(rest ^ at[above - base]).astype(np.int64)
            order = np.lexsort((edge, above))
            rest, above, edge = rest[order], above[order], edge[order]
            head = np.ones(len(rest), bool)
            head[1:] = (above[1:] != above[:-1]) | (edge[1:] != edge[:-1])
            nodes.append(rest[head])
            edges.append(edge[head])
            parents.append(above[head])
            child = size + np.cumsum(head) - 1
            base, at = size, rest[head]
            size += len(at)
            rest, above = rest[~head], child[~head]
        self.values, self.edges = np.concatenate(nodes), np.concatenate(edges)
        parents = np.concatenate(parents)
        self.first = np.searchsorted(parents, np.arange(len(self.values)))
        self.count = np.bincount(parents[1:], minlength=len(self.values))

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) of all pairs within the radius, as positions."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        found = []
        while len(query):
            distance = np.bitwise_count(self.values[node] ^ queries[query]).astype(np.int64)
            near = distance <= radius
            found.append((query[near], node[near]))
            count = self.count[node]
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            child = np.repeat(self.first[node], count) + step
            follow = np.abs(self.edges[child] - np.repeat(distance, count)) <= radius
            query, node = np.repeat(query, count)[follow], child[follow]
        return tuple(np.concatenate(part) for part in zip(*found))


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of ``n`` positions reaches by the links."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def linked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between distinct fingerprints: (fingerprint, head of its group)."""
    tree = Tree(values)
    values = tree.values
    label = np.arange(len(values))
    for i in range(0, len(values), QUERIES):
        query, node = tree.within(values[i : i + QUERIES], RADIUS)
        some = query + i != node
        label = _merge(label, query[some] + i, node[some])
    other = label != np.arange(len(label))
    return values[other], values[label[other]]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels after further links."""
    if not len(a):
        return label
    return _stars(len(label), np.concatenate([np.arange(len(label)), a]), np.concatenate([label, b]))


# --- shards ---------------------------------------------------------------------------


def _block(value: Column, i: int, bits: int, of: int) -> Column:
    """Block ``i`` of ``of`` blocks of ``bits`` bits, the highest first."""
    return F.shiftrightunsigned(value, (of - 1 - i) * bits).bitwiseAND((1 << bits) - 1)


def _choices(value: Column, bits: int) -> list[tuple[Column, Column]]:
    """For each choice of two of four blocks: the choice with their bits, and the other bits."""
    found = []
    for number, (i, j) in enumerate(combinations(range(4), 2)):
        k, m = (x for x in range(4) if x not in (i, j))
        one, two, three, four = (_block(value, x, bits, 4) for x in (i, j, k, m))
        own = F.lit(number << 2 * bits).cast("long").bitwiseOR(F.shiftleft(one, bits)).bitwiseOR(two)
        found.append((own, F.shiftleft(three, bits).bitwiseOR(four)))
    return found


def _shared(rows: DataFrame) -> DataFrame:
    """The rows of keys that several rows have, with their number ``n``."""
    several = written(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")
    return rows.join(several, "key")


def shards(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(key, fp) of the shards of distinct fingerprints that hold more than one."""
    pairs = F.array(*[F.struct(k.alias("key"), r.alias("rest")) for k, r in _choices(F.col("fp"), 16)])
    rows = _shared(distinct.select("fp", F.inline(pairs)))
    rows = written(rows, "sharded")
    # Within a hot shard by two of the four bytes of the other 32 bits.
    finer = [(F.shiftleft(F.col("key"), 19).bitwiseOR(F.lit(1 << 62)).bitwiseOR(k)).alias("key") for k, _ in _choices(F.col("rest"), 8)]
    cut = rows.where(F.col("n") > hot).select("fp", F.explode(F.array(*finer)).alias("key"))
    return rows.where(F.col("n") <= hot).select("key", "fp").unionByName(_shared(cut).select("key", "fp"))


def _link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for members in batch.column(0):
            values = members.values.to_numpy().view(np.uint64)
            if len(values) == 2:
                # A tree of a root and one child.
                some = np.bitwise_count(values[:1] ^ values[1:]) <= RADIUS
                one, two = values[1:][some], values[:1][some]
            else:
                one, two = linked(values)
            a.append(one)
            b.append(two)
        columns = [pa.array(np.concatenate(part).view(np.int64)) for part in (a, b)]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b) that join all distinct fingerprints within the radius of each other."""
    members = shards(distinct, hot).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("members"))
    return members.select("members").mapInArrow(_link, "a long, b long")


def _attached(rows: DataFrame, key: str, table: DataFrame, other: str) -> DataFrame:
    """Left join on a key that very many rows may share."""
    return skew_join(rows, table, (key, other), "left", find_hot_keys(rows=(rows, F.col(key)))["rows"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", hot: int = HOT) -> DataFrame:
    """(key, fingerprint, component_id) of each row; the key is a 64-bit integer."""
    rows = written(fingerprints(docs, key, text), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    found = written(links(nodes.select("fp"), hot).distinct(), "links")
    label = components(found)
    nodes = nodes.join(label.toDF("node", "head"), F.col("fp") == F.col("node"), "left")
    nodes = written(nodes.select("fp", "least", F.coalesce("head", "fp").alias("head")), "labelled")
    least = nodes.groupBy(F.col("head").alias("of")).agg(F.min("least").alias("component_id"))
    classes = _attached(nodes.select("fp", "head"), "head", written(least, "classes"), "of")
    classes = written(classes.select(F.col("fp").alias("of"), "component_id"), "components")
    return _attached(rows, "fp", classes, "of").select(
        F.col("id").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
