"""Latest row per key: the meaning of a keyed upsert table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row of each key in the given order.

    A row-number filter of 1 lets Spark keep one row per key and task before the
    shuffle (WindowGroupLimit), so a hot key sends one row per map task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def latest_by_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row of each key; ``version`` columns are compared in turn."""
    return first_by_key(df, keys, [F.col(v).desc_nulls_last() for v in version])


def latest_of_topic(records: DataFrame) -> DataFrame:
    """Newest record of each key of an upsert topic; a key whose newest record has no value is gone.

    ``records`` has ``key``, ``value``, ``partition`` and ``seq``, the offset. A key lies in one
    partition as long as their number stays; after a change of it the higher partition counts.
    A record read twice counts once. Records without a key cannot be updated and are left out.
    """
    keyed = records.where(F.col("key").isNotNull())
    return latest_by_key(keyed, ["key"], ["partition", "seq"]).where(F.col("value").isNotNull())
