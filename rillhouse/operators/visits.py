"""Visitor operators over log rows: new-visitor flag, daily visitors, bounces.

Rows carry ``mid`` (device), ``ts`` (epoch ms) and ``seq`` (breaks ties of ts).
A single device may hold a large share of all rows, so nothing here gathers all
rows of a device in one task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillhouse.functions.dates import day_of_millis
from rillhouse.operators.latest import first_by_key
from rillhouse.operators.skew import HotKeys, find_hot_keys


def flagged() -> Column:
    """Whether a row claims to come from a new visitor."""
    return F.coalesce(F.col("is_new") == "1", F.lit(False))


def first_days(log: DataFrame, tz: str | None = None) -> DataFrame:
    """First visit day of each device: (mid, first_day).

    The day of its earliest row, or the day before if that row does not claim a
    new visitor. Partially aggregated, so one row per device and task is shuffled.
    """
    day = day_of_millis(F.col("ts"), tz)
    start = F.when(flagged(), day).otherwise(F.date_sub(day.cast("date"), 1).cast("string"))
    return (
        log.select("mid", "ts", "seq", start.alias("day"))
        .groupBy("mid")
        .agg(F.min_by("day", F.struct("ts", "seq")).alias("first_day"))
    )


def clear_flag(common: Column) -> Column:
    """The ``common`` object with its new-visitor flag set to "0"."""
    kept = F.map_filter(
        F.try_variant_get(common, "$", "map<string,variant>"), lambda k, _: k != "is_new"
    )
    zero = F.create_map(F.lit("is_new"), F.parse_json(F.lit('"0"')))
    return F.to_variant_object(F.map_concat(kept, zero))


def fix_is_new(log: DataFrame, days: DataFrame | None = None, tz: str | None = None) -> DataFrame:
    """Repair the new-visitor flag: a claim on another day than the first is cleared.

    Only rows that claim a new visitor are joined with the first days; all other
    rows pass by without a shuffle.
    """
    days = first_days(log, tz) if days is None else days
    claims = log.where(flagged())
    known = days.select(F.col("mid").alias("_mid"), "first_day")
    # One row a device on the right: a hot device's claims are left to AQE's skew join.
    joined = claims.join(known, F.col("mid") == F.col("_mid"), "left")
    stale = F.col("first_day") != day_of_millis(F.col("ts"), tz)
    fixed = joined.withColumn("_stale", F.coalesce(stale, F.lit(False)))
    changed = {"is_new": F.when(F.col("_stale"), "0").otherwise(F.col("is_new"))}
    if "common" in log.columns:
        changed["common"] = F.when(F.col("_stale"), clear_flag(F.col("common"))).otherwise(
            F.col("common")
        )
    return log.where(~flagged()).unionByName(fixed.withColumns(changed).select(*log.columns))


def is_entry() -> Column:
    """Whether a page row starts a visit: it has no previous page."""
    return F.col("last_page_id").isNull()


def unique_visitor(pages: DataFrame, tz: str | None = None) -> DataFrame:
    """First entry page of each device and day, with the day as ``dt``."""
    entries = pages.where(is_entry()).withColumn("dt", day_of_millis(F.col("ts"), tz))
    return first_by_key(entries, ["mid", "dt"], [F.col("ts").asc(), F.col("seq").asc()])


_FIRST = -(2**63)  # before any seq


def _quantiles(
    pages: DataFrame, keys: list[str], value: str, cells: dict[tuple, int]
) -> dict[tuple, list[int]]:
    """Values that cut the rows of each given key into its number of cells.

    Cell counts are rounded up to powers of two so that one pass serves all keys;
    the driver receives at most twice as many numbers as there are cells.
    """
    cells = {key: 1 << (n - 1).bit_length() for key, n in cells.items()}
    schema = T.StructType([pages.schema[k] for k in keys]).add("_n", T.IntegerType())
    sizes = pages.sparkSession.createDataFrame([(*k, n) for k, n in cells.items()], schema)
    quantiles = []
    for n in sorted(set(cells.values())):
        shares = [i / n for i in range(1, n)]
        own = F.when(F.col("_n") == n, F.col(value))
        quantiles.append(F.percentile_approx(own, shares, max(10_000, 10 * n)).alias(f"at_{n}"))
    rows = pages.join(F.broadcast(sizes), keys).groupBy(*keys).agg(*quantiles).collect()
    found = {tuple(r[k] for k in keys): r for r in rows}
    return {key: found[key][f"at_{n}"] or [] for key, n in cells.items()}


def _cut_points(pages: DataFrame, hot: HotKeys) -> list[tuple[str, list[tuple[int, int]]]]:
    """(ts, seq) points that cut the time line of each hot device into its cells.

    An event time that takes up several quantiles holds as many cells of rows
    itself; it is cut again, by ``seq``.
    """
    times = _quantiles(pages, ["mid"], "ts", {(mid,): n for mid, n in hot.items()})
    cuts = {mid: {(at, _FIRST) for at in found} for (mid,), found in times.items()}
    bursts = {
        (mid, at): hits + 1
        for (mid,), found in times.items()
        for at, hits in Counter(found).items()
        if hits > 1
    }
    if bursts:
        for (mid, at), found in _quantiles(pages, ["mid", "ts"], "seq", bursts).items():
            cuts[mid] |= {(at, seq) for seq in found}
    return [(mid, sorted(points)) for mid, points in cuts.items()]


def _passed(cuts: np.ndarray, ts: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """How many of the sorted (ts, seq) cut points each row has reached."""
    found = np.searchsorted(cuts["ts"], ts, side="left")
    upto = np.searchsorted(cuts["ts"], ts, side="right")
    for at in np.unique(ts[upto > found]):
        rows = np.flatnonzero(ts == at)
        low, high = found[rows[0]], upto[rows[0]]
        found[rows] = low + np.searchsorted(cuts["seq"][low:high], seq[rows], side="right")
    return found


def _sliced(pages: DataFrame, hot: HotKeys) -> DataFrame:
    """Number the rows of each hot device by slices of its time line, others 0.

    The cut points are quantiles of the device's own rows, so its slices hold
    about equal row counts. They are fixed once, on the driver, so that every use
    of the result sees the same slices; fewer than 4P are needed for P shuffle
    partitions. Rows of hot devices find their slice by binary search.
    """
    kind = np.dtype([("ts", np.int64), ("seq", np.int64)])
    cuts = {mid: np.array(points, kind) for mid, points in _cut_points(pages, hot)}

    @F.pandas_udf("int")
    def slice_of(mid: pd.Series, ts: pd.Series, seq: pd.Series) -> pd.Series:
        found = np.zeros(len(mid), np.int32)
        for device, rows in mid.groupby(mid).indices.items():
            found[rows] = _passed(cuts[device], ts.to_numpy()[rows], seq.to_numpy()[rows])
        return pd.Series(found)

    is_hot = F.coalesce(F.col("mid").isin(list(hot)), F.lit(False))
    number = slice_of("mid", "ts", F.coalesce("seq", F.lit(_FIRST)))
    return pages.where(is_hot).withColumn("_slice", number).unionByName(
        pages.where(~is_hot).withColumn("_slice", F.lit(0))
    )


def with_next(pages: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Add ``next_ts`` and ``next_entry``, from the device's next row in (ts, seq) order.

    Devices with few rows are ordered whole. The time line of a hot device is cut
    into slices ordered apart, and the last row of a slice looks up the first row
    of the device's next slice; that lookup has one row per slice.
    """
    if hot is None:
        hot = find_hot_keys(pages=(pages, F.col("mid")))["pages"]
    hot = {mid: cells for mid, cells in hot.items() if mid is not None}
    after = F.struct(F.col("ts"), F.col("seq"), is_entry().alias("entry"))
    if not hot:
        order = Window.partitionBy("mid").orderBy("ts", "seq")
        ahead = pages.withColumn("_next", F.lead(after).over(order))
    else:
        sliced = _sliced(pages, hot)
        order = Window.partitionBy("mid", "_slice").orderBy("ts", "seq")
        heads = (
            sliced.where(F.col("mid").isin(list(hot)))
            .groupBy(F.col("mid").alias("_m"), F.col("_slice").alias("_s"))
            .agg(F.min(after).alias("_first"))
        )
        # At most one row per cut point and hot device: small by construction.
        line = Window.partitionBy("_m").orderBy("_s")
        heads = heads.select("_m", "_s", F.lead("_first").over(line).alias("_follow"))
        ahead = (
            sliced.withColumn("_near", F.lead(after).over(order))
            .join(
                F.broadcast(heads),
                (F.col("mid") == F.col("_m")) & (F.col("_slice") == F.col("_s")),
                "left",
            )
            .withColumn("_next", F.coalesce("_near", "_follow"))
        )
    return ahead.select(
        *pages.columns,
        F.col("_next.ts").alias("next_ts"),
        F.col("_next.entry").alias("next_entry"),
    )


def jump_match(within_ms: int) -> Column:
    """The next row is again an entry, inside the window."""
    return F.col("next_entry") & (F.col("next_ts") - F.col("ts") < within_ms)


def jump_timeout(within_ms: int) -> Column:
    """No next row, or none inside the window."""
    return F.col("next_ts").isNull() | (F.col("next_ts") - F.col("ts") >= within_ms)


def user_jump(
    pages: DataFrame, within_ms: int = 10_000, part: str = "all", hot: HotKeys | None = None
) -> DataFrame:
    """Bounced visits: entry rows followed by no onward page inside the window.

    ``part`` selects the rows found by the next entry ("match"), those found by
    the window running out ("timeout"), or both.
    """
    parts = {
        "match": jump_match(within_ms),
        "timeout": jump_timeout(within_ms),
        "all": jump_match(within_ms) | jump_timeout(within_ms),
    }
    return (
        with_next(pages, hot).where(is_entry()).where(parts[part]).drop("next_ts", "next_entry")
    )
