"""Joins that stay balanced when one key holds a large share of the rows.

A key counts as hot when it holds more rows than two average shuffle partitions,
that is more than 2/P of its table for P shuffle partitions. Fewer than P/2 keys
can do so, which bounds everything collected or broadcast here by P, whatever
the size of the data.

Hot keys only steer how rows are spread over tasks. They never add, drop or cap
rows: rows of a hot key are dealt over several cells of the join and the rows
they meet are repeated in each of those cells. Rows are dealt by a hash of their
values, so a task that is run again deals them alike; copies equal in every
column stay together and are left to AQE's skew-join splitting.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hot key (None is the null key) -> number of cells its rows are dealt over.
HotKeys = dict[str | None, int]

_MAX_TRACKED = 1_000_000  # upper limit of Spark's frequent-items sketch
#: Estimated bytes up to which a lookup is broadcast. The estimate goes by files, in which text that repeats
#: hardly counts: 12.7 MB of part names were over 900 MB on the driver.
_BROADCAST_BYTES = 5 << 20
#: Bytes of a table on disk for each partition that its shuffles start with.
SHUFFLE_BYTES = 4 << 20
_HOT_PARTITIONS = 2  # average shuffle partitions a key may fill before it is split


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session plans with."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_finely(spark: SparkSession, rows: DataFrame) -> None:
    """Let shuffles start with partitions that a task sorts in memory, by the size of a large table.

    AQE merges those that prove small, so a small table is shuffled as before. A session that starts
    with more partitions keeps its number.
    """
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    wanted = 1 + estimated_bytes(rows) // SHUFFLE_BYTES
    if wanted > max(shuffle_width(spark), int(spark.conf.get(name, "1"))):
        spark.conf.set(name, str(wanted))


def find_hot_keys(**sides: tuple[DataFrame, Column]) -> dict[str, HotKeys]:
    """Hot keys of several (frame, key) sides, from one pass over the key columns.

    The frequent-items sketch is merged map-side, so the shuffle carries one
    sketch per task and side and the driver receives at most P keys per side.
    """
    spark = next(iter(sides.values()))[0].sparkSession
    width = shuffle_width(spark)
    top = min(width, _MAX_TRACKED // 8)
    tracked = max(10_000, 8 * top)
    keys = [
        df.select(F.lit(name).alias("side"), key.cast("string").alias("key"))
        for name, (df, key) in sides.items()
    ]
    sketched = (
        reduce(DataFrame.unionAll, keys)
        .groupBy("side")
        .agg(
            F.expr(f"approx_top_k(key, {top}, {tracked})").alias("top"),
            F.count(F.lit(1)).alias("total"),
        )
    )
    found: dict[str, HotKeys] = {name: {} for name in sides}
    for row in sketched.collect():
        for item in row["top"]:
            partitions = item["count"] * width / row["total"]
            if partitions > _HOT_PARTITIONS:
                found[row["side"]][item["item"]] = math.ceil(partitions)
    return found


def _grid(spark: SparkSession, left: HotKeys, right: HotKeys) -> DataFrame:
    """Cells per hot key as a table of fewer than P rows."""
    rows = []
    for key in {**left, **right}:
        cells_l, cells_r = left.get(key, 1), right.get(key, 1)
        if cells_l > 1 and cells_r > 1:
            # Hot on both sides: a square grid repeats each side least.
            cells_l, cells_r = math.isqrt(cells_l - 1) + 1, math.isqrt(cells_r - 1) + 1
        rows.append((key, cells_l, cells_r))
    schema = T.StructType(
        [
            T.StructField("_hot_key", T.StringType()),
            T.StructField("_cells_l", T.IntegerType()),
            T.StructField("_cells_r", T.IntegerType()),
        ]
    )
    return F.broadcast(spark.createDataFrame(rows, schema))


def _row_hash(df: DataFrame) -> Column:
    """Hash over the columns of a row that Spark can hash.

    A value of the row, and so the same when a lost task is run again.
    """
    def hashable(t: T.DataType) -> bool:
        if isinstance(t, T.ArrayType):
            return hashable(t.elementType)
        if isinstance(t, T.StructType):
            return all(hashable(f.dataType) for f in t.fields)
        return not isinstance(t, (T.MapType, T.VariantType))

    return F.xxhash64(*[F.col(f.name) for f in df.schema.fields if hashable(f.dataType)])


def _deal(df: DataFrame, key: str, grid: DataFrame, own: str, other: str) -> DataFrame:
    """Give each row its own cell and repeat it over the other side's cells."""
    near, far = f"_cell{own}", f"_cell{other}"
    return (
        df.withColumn("_hash", _row_hash(df))
        .join(grid, F.col(key).cast("string").eqNullSafe(F.col("_hot_key")), "left")
        .withColumn(
            near,
            F.coalesce(F.pmod("_hash", f"_cells{own}"), F.lit(0)).cast("int"),
        )
        .withColumn(
            far,
            F.explode(F.sequence(F.lit(0), F.coalesce(f"_cells{other}", F.lit(1)) - 1)),
        )
        .drop("_hash", "_hot_key", f"_cells{own}")
    )


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: tuple[str, str],
    how: str = "inner",
    hot_left: Mapping[str | None, int] | None = None,
    hot_right: Mapping[str | None, int] | None = None,
    also: Column | None = None,
) -> DataFrame:
    """Equi-join on differently named key columns, balanced for the hot keys given.

    ``also`` is a further condition of an inner join.

    ``how`` is "inner" or "left". The right key column is kept in the result.
    Without hot keys this is the plain join, and AQE may still turn it into a
    broadcast join when a side proves small. For a left join ``hot_right`` must
    have been found on ``right`` itself.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    if also is not None and how != "inner":
        raise ValueError("a further condition needs an inner join")
    also = F.lit(True) if also is None else also
    key_l, key_r = on
    if how == "inner":
        left, right = left.where(F.col(key_l).isNotNull()), right.where(F.col(key_r).isNotNull())
    hot_left, hot_right = dict(hot_left or {}), dict(hot_right or {})
    if how == "inner":
        hot_left.pop(None, None)
    hot_right.pop(None, None)  # a null right key meets nothing
    if not hot_left and not hot_right:
        return left.join(right, (F.col(key_l) == F.col(key_r)) & also, how)

    grid = _grid(left.sparkSession, hot_left, hot_right)
    dealt_l = _deal(left, key_l, grid, "_l", "_r")
    dealt_r = _deal(right, key_r, grid, "_r", "_l").withColumnsRenamed(
        {"_cell_l": "_at_l", "_cell_r": "_at_r"}
    ).drop("_cells_l")
    joined = dealt_l.join(
        dealt_r,
        (F.col(key_l) == F.col(key_r))
        & (F.col("_cell_l") == F.col("_at_l"))
        & (F.col("_cell_r") == F.col("_at_r"))
        & also,
        how,
    )
    if how == "left":
        # A left row repeated over several cells of a right-hot key has its
        # matches in some of them; the cells without one must not pad it.
        joined = joined.where(
            F.col(key_r).isNotNull() | (F.coalesce("_cells_r", F.lit(1)) == 1)
        )
    return joined.drop("_cell_l", "_cell_r", "_cells_r", "_at_l", "_at_r")


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate of a frame's size; very large where it knows nothing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def collect_small(df: DataFrame, max_rows: int = 10_000) -> list[Row]:
    """All rows of a small table, such as the configuration, on the driver.

    A larger one is refused rather than cut.
    """
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    return rows


def lookup_join(
    rows: DataFrame,
    dim: DataFrame,
    on: tuple[str, str],
    how: str = "left",
    max_bytes: int = _BROADCAST_BYTES,
) -> DataFrame:
    """Join with a lookup table of one row a code: broadcast if Spark knows it to be small.

    Otherwise the plain join, of which AQE splits hot codes on the left, or which
    it turns into a broadcast once it has seen the size of the table.
    """
    small = estimated_bytes(dim) <= max_bytes
    return rows.join(F.broadcast(dim) if small else dim, F.col(on[0]) == F.col(on[1]), how)
