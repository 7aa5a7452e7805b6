"""Balanced joins against joins worked out by hand."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rillhouse import registry
from rillhouse.operators import skew


def brute(left, right, how):
    by_key = {}
    for k, v in right:
        by_key.setdefault(k, []).append((k, v))
    out = []
    for k, v in left:
        found = by_key.get(k, []) if k is not None else []
        if found:
            out += [(k, v, *r) for r in found]
        elif how == "left":
            out.append((k, v, None, None))
    return Counter(out)


def sides(rng, n, hot_left, hot_right):
    def key(hot):
        if rng.random() < 0.05:
            return None
        return "hot" if rng.random() < hot else f"k{rng.randrange(60)}"

    return (
        [(key(hot_left), i) for i in range(n)],
        [(key(hot_right), i) for i in range(n // 4)],
    )


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_left, hot_right", [(0, 0), (0.4, 0), (0, 0.4), (0.4, 0.4), (0.01, 0.9)])
def test_skew_join(spark, how, hot_left, hot_right):
    left, right = sides(random.Random(5), 800, hot_left, hot_right)
    a = spark.createDataFrame(left, "a string, x int")
    b = spark.createDataFrame(right, "b string, y int")
    hot = skew.find_hot_keys(a=(a, F.col("a")), b=(b, F.col("b")))
    if hot_left > 0.1:
        assert "hot" in hot["a"]
    if hot_right > 0.1:
        assert "hot" in hot["b"]
    joined = skew.skew_join(a, b, ("a", "b"), how, hot["a"], hot["b"])
    assert joined.columns == ["a", "x", "b", "y"]
    assert Counter(tuple(r) for r in joined.collect()) == brute(left, right, how)


def test_null_keys_of_a_left_join(spark):
    left = [(None, i) for i in range(500)] + [("k", 1)]
    a = spark.createDataFrame(left, "a string, x int")
    b = spark.createDataFrame([("k", 9), (None, 3)], "b string, y int")
    hot = skew.find_hot_keys(a=(a, F.col("a")))["a"]
    assert None in hot
    joined = skew.skew_join(a, b, ("a", "b"), "left", hot)
    assert Counter(tuple(r) for r in joined.collect()) == brute(left, [("k", 9), (None, 3)], "left")


def test_hot_rows_are_spread_over_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        a = spark.range(12_000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("a"),
            F.col("id").alias("x"),
        )
        b = spark.createDataFrame([("hot", 1)], "b string, y int")
        hot = skew.find_hot_keys(a=(a, F.col("a")))["a"]
        joined = skew.skew_join(a, b, ("a", "b"), "left", hot)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 12_000
        assert max(sizes) < 4_000  # the hot key alone has 4,000 rows
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_lookup_join_beyond_the_limit(spark):
    rows = [("hot" if i % 3 else f"k{i % 50}", i) for i in range(600)]
    dim = [("hot", "H")] + [(f"k{i}", f"K{i}") for i in range(25)]
    a = spark.createDataFrame(rows, "a string, x int")
    d = spark.createDataFrame(dim, "code string, name string")
    values = ", ".join(map(str, dim))
    known = spark.sql(f"SELECT * FROM VALUES {values} AS d(code, name)")
    small = skew.lookup_join(a, known, ("a", "code"))
    large = skew.lookup_join(a, known, ("a", "code"), max_bytes=5)
    unknown = skew.lookup_join(a, d, ("a", "code"))
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in unknown._jdf.queryExecution().analyzed().toString()
    found = Counter(map(tuple, small.collect()))
    assert found == Counter(map(tuple, large.collect())) == Counter(map(tuple, unknown.collect()))
    assert 0 < skew.estimated_bytes(known) < 10_000 < skew.estimated_bytes(d)


def test_lookup_of_many_rows_is_not_broadcast(spark):
    """A million rows take many times their estimate of 8 MB on the driver."""
    rows = spark.range(0, 2_000_000, 1_000).withColumnRenamed("id", "a")
    for n, hinted in ((1_000, True), (1_000_000, False)):
        dim = spark.range(n).select(F.col("id").alias("code"))
        found = skew.lookup_join(rows, dim, ("a", "code"))
        assert ("ResolvedHint" in found._jdf.queryExecution().analyzed().toString()) == hinted
        assert (found.count(), found.where("code IS NOT NULL").count()) == (2_000, n // 1_000)


def test_few_keys_are_collected(spark):
    """The number of hot keys is bounded by the shuffle width, not by the data."""
    a = spark.range(50_000).select(F.col("id").cast("string").alias("a"))
    assert skew.find_hot_keys(a=(a, F.col("a")))["a"] == {}


def test_shuffles_start_with_partitions_of_bounded_size(spark, monkeypatch):
    """The trade joins of a large table start with more partitions than the session's."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    monkeypatch.setattr(skew, "SHUFFLE_BYTES", 2_000)
    try:
        rows = registry.queries()["trade_order_detail"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name, "1")) > 8
        placed = rows.collect()
    finally:
        spark.conf.unset(name)
    monkeypatch.undo()
    again = registry.queries()["trade_order_detail"](spark, "/root/testdata/sf0.001").collect()
    assert Counter(placed) == Counter(again)
