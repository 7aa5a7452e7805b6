"""Merkle manifest of a dataset, with proofs found by descending a content-addressed DAG.

Every row is a leaf. The leaves of a group (a source), in the order of their ids, are hashed in
runs of 16 until one digest is left, the group's subroot; the subroots, in the order of their
groups, are hashed in the same way to the root. The manifest stores one record per inner node,
from its digest to those of its children, so that equal subtrees are stored once.

A leaf is requested by its path: the hexadecimal digits of its group's rank, then those of its own
rank in the group, from the root down. Requests that share a prefix descend together as one row;
at each record the child of the next digit is followed and the others are kept as a path segment.
The segments, reversed, are the proof of the leaf.

Digests are lowercase hexadecimal SHA-256 of concatenated text. The text of a row is that of each
of its columns: ``-`` for null, else the number of its UTF-8 bytes, ``:``, and the value.

* Null ids come first in their group; rows of one id are ordered by their digests. Equal rows are
  separate leaves of one digest. A null group comes first and is not the empty group.
* A text of any length is one value; an empty one is ``0:``.
* An empty table has no leaves, no records and no root: its proofs are an empty table.
* Further columns are ignored, whatever their names.

Ranks come from a range partitioning by group, id and digest: each partition counts its rows of a
group, and the counts before it are summed over the partitions, never over rows. A group of any
size is therefore spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.tables import written
from rillhouse.operators.skew import lookup_join

#: The columns of a row that its leaf covers (fixed values).
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node: one hexadecimal digit.
FAN = 16
_LEVELS = 16
_RECORD = {"digest": "string", "children": "array<string>"}


def leaf_digest(columns: Mapping[str, Column] | Sequence[str] = COLUMNS) -> Column:
    """The digest of a row with the given columns; a mapping gives their values."""
    values = columns.values() if isinstance(columns, Mapping) else [F.col(c) for c in columns]
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """A tree over rows: ``leaves`` (id, leaf, path, further columns) and ``records``.

    ``group_digits`` is the number of leading path digits that lead to a group's subroot.
    """

    leaves: DataFrame
    records: DataFrame
    root: str | None
    group_digits: int


def _group_key(group: Column) -> Column:
    """Text that orders groups bytewise, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def _depth(total: Column) -> Column:
    """Levels above ``total`` nodes: the least d with 16 to the power d of at least ``total``."""
    steps = [(total > FAN**d).cast("int") for d in range(_LEVELS - 1)]
    return reduce(lambda a, b: a + b, steps)


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with their ``rank`` in their group ``g`` and the group's ``depth``."""
    placed = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    # Position in the partition: the low 33 bits of the generated id.
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = written(placed.select("*", F.spark_partition_id().alias("part"), at.alias("at")), "placed")
    spans = placed.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = "coalesce(sum(n) over (partition by g order by part rows between unbounded preceding and 1 preceding), 0)"
    spans = spans.selectExpr("g", "part", f"{before} - first as shift", "sum(n) over (partition by g) as total")
    spans = spans.select(F.concat_ws("/", "part", "g").alias("span"), "shift", _depth(F.col("total")).alias("depth"))
    own = placed.withColumn("_span", F.concat_ws("/", "part", "g"))
    found = lookup_join(own, written(spans, "spans"), ("_span", "span"), "inner")
    return found.withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "_span", "span", "shift")


def _tree(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(records of each level, (g, digest) of each group's top) of ranked nodes (g, rank, depth, digest)."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    level, records = nodes.select("g", "rank", "depth", "digest"), []
    tops = level.where("depth = 0").select("g", "digest")
    for k in range(1, deepest + 1):
        below = level.where(F.col("depth") >= k)
        runs = below.groupBy("g", F.shiftright("rank", 4).alias("rank"), "depth").agg(
            F.array_sort(F.collect_list(F.struct("rank", "digest"))).alias("run")
        )
        children = F.col("run")["digest"]
        digest = F.sha2(F.array_join(children, ""), 256).alias("digest")
        level = written(runs.select("g", "rank", "depth", digest, children.alias("children")), f"level-{k}")
        records.append(level.select("digest", "children"))
        tops = tops.unionByName(level.where(F.col("depth") == k).select("g", "digest"))
    return records, tops


def _digits(number: str, length: str) -> Column:
    """A number as hexadecimal digits; no digits for a length of 0."""
    return F.expr(f"lower(lpad(hex({number}), {length}, '0'))")


def build(
    docs: DataFrame,
    key: str = "doc_id",
    group: str = "source",
    leaf: Column | None = None,
    carried: Mapping[str, Column] | None = None,
) -> Manifest:
    """The manifest of a table; ``carried`` columns travel with the leaves."""
    spark = docs.sparkSession
    leaf = leaf_digest() if leaf is None else leaf
    more = {name: c.alias(name) for name, c in (carried or {}).items()}
    rows = docs.select(_group_key(F.col(group)).alias("g"), F.col(key).alias("id"), leaf.alias("digest"), *more.values())
    leaves = written(_ranked(rows, ["id", "digest"]), "ranked")
    records, tops = _tree(leaves)
    tops = written(tops.select(F.col("g").alias("of"), "digest", F.lit("").alias("g")), "tops")
    groups = written(_ranked(tops, ["of"]), "groups")
    top_records, roots = _tree(groups)
    root, digits = roots.first(), groups.agg(F.max("depth")).first()[0] or 0
    head = written(groups.select(F.col("of"), _digits("rank", "depth").alias("head")), "heads")
    placed = lookup_join(leaves, head, ("g", "of"), "inner")
    path = F.concat("head", _digits("rank", "depth")).alias("path")
    placed = placed.select("id", F.col("digest").alias("leaf"), path, *more)
    # Without a Python worker, which local rows would start on each executor.
    none = spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in _RECORD.items()))
    stored = reduce(DataFrame.unionByName, records + top_records, none)
    stored = stored.dropDuplicates(["digest"])
    return Manifest(written(placed, "leaves"), written(stored, "records"), root and root.digest, digits)


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The requests (rows with a ``path``) with what their descent finds.

    ``found`` is the digest at the end of the path, ``subroot`` the one at the end of its group
    digits, ``proof`` the segments from the leaf up: the digests before and behind it in each run,
    each as one text. Requests may repeat; a path that leads nowhere gives no row.
    """
    spark = requests.sparkSession
    way = "array<struct<left:string,right:string>>"
    at_root = {
        "found": F.lit(manifest.root).cast("string"),
        "subroot": F.lit(None if manifest.group_digits else manifest.root).cast("string"),
        "way": F.array().cast(way),
    }
    # A manifest without rows has no root to start from.
    requests = requests if manifest.root else requests.where("false")
    # Every proper prefix of a requested path, once.
    parents = requests.where("path != ''").selectExpr("left(path, length(path) - 1) as prefix").distinct()
    prefix = F.explode(F.expr("transform(sequence(0, length(prefix)), n -> left(prefix, n))")).alias("prefix")
    prefixes = written(parents.select(prefix).distinct(), "prefixes")
    deepest = prefixes.agg(F.max(F.length("prefix"))).first()[0]
    longest = 0 if deepest is None else deepest + 1

    def follow(rows: DataFrame, path: str, opened: DataFrame, length: int) -> DataFrame:
        """The rows one digit further: the child they follow, the others as a segment."""
        met = rows.withColumn("_parent", F.left(path, F.lit(length - 1))).join(opened, "_parent")
        met = met.withColumn("_digit", F.expr(f"cast(conv(substr({path}, {length}, 1), 16, 10) as int)"))
        found = F.get("_children", "_digit")
        segment = F.expr(
            "struct(array_join(slice(_children, 1, _digit), '') as left,"
            f" array_join(slice(_children, _digit + 2, {FAN}), '') as right)"
        )
        subroot = found if length == manifest.group_digits else F.col("_subroot")
        way = F.concat("_way", F.array(segment))
        return met.where(found.isNotNull()).select(*rows.columns, found.alias("found"), subroot.alias("subroot"), way.alias("way"))

    proofs = [requests.where("path = ''").withColumns(at_root)]
    front = spark.range(1).select(F.lit("").alias("prefix")).withColumns(at_root)
    for length in range(1, longest + 1):
        opened = front.join(manifest.records, front.found == manifest.records.digest).select(
            F.col("prefix").alias("_parent"),
            F.col("subroot").alias("_subroot"),
            F.col("way").alias("_way"),
            F.col("children").alias("_children"),
        )
        opened = written(opened, f"opened-{length}")
        proofs.append(follow(requests.where(F.length("path") == length), "path", opened, length))
        if length < longest:
            front = follow(prefixes.where(F.length("prefix") == length), "prefix", opened, length)
    rows = reduce(DataFrame.unionByName, proofs)
    return rows.withColumn("proof", F.reverse("way")).drop("way")


def proof_digest() -> Column:
    """The digest of all digests of a proof."""
    each = F.transform("proof", lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(each, ""), 256)


def folded(leaf: str) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    up = lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256)
    return F.aggregate("proof", F.col(leaf), up)
