"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillhouse.llm.tables import written


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    mins = _mins(both).select("u", F.least("u", "least").alias("m"))
    return both.where("v > u").join(mins, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    mins = _mins(edges)
    moved = edges.join(mins, "u").where("v > least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(mins.select("u", F.col("least").alias("v")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that differs from its component, the least node in reach.

    Each round is written to the shared folder; rounds end when the edges no longer change. Their
    number grows with the logarithm of the largest component.
    """
    left, right = F.col(a), F.col(b)
    current = edges.where(left != right).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    )
    current = written(current.distinct(), "edges")
    before = None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first()
        if state == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
        current = written(_small_star(_large_star(current).distinct()).distinct(), "edges")
