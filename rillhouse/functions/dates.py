"""Epoch-millisecond and date-text conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = "yyyy-MM-dd"
SECOND = "yyyy-MM-dd HH:mm:ss"


def _local(ts_ms: Column, tz: str | None) -> Column:
    """The instant as a timestamp; with ``tz``, as wall-clock time in that zone."""
    if tz is None:
        return F.timestamp_millis(ts_ms)
    return F.convert_timezone(
        F.lit("UTC"),
        F.lit(tz),
        F.timestamp_add("MILLISECOND", ts_ms, F.lit("1970-01-01").cast("timestamp_ntz")),
    )


def day_of_millis(ts_ms: Column, tz: str | None = None) -> Column:
    """``yyyy-MM-dd`` of an epoch-millisecond value, session zone unless given."""
    return F.date_format(_local(ts_ms, tz), DAY)


def second_of_millis(ts_ms: Column, tz: str | None = None) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` of an epoch-millisecond value."""
    return F.date_format(_local(ts_ms, tz), SECOND)


def millis_of_text(text: Column, full: bool = False, offset: str = "+08:00") -> Column:
    """Epoch milliseconds of a date (or, with ``full``, date-time) text at ``offset``.

    Text of another format gives null.
    """
    stamp = text if full else F.concat(text, F.lit(" 00:00:00"))
    zoned = F.concat(stamp, F.lit(f" {offset}"))
    return F.unix_millis(F.try_to_timestamp(zoned, F.lit(f"{SECOND} XXX")))


def day_of_text(text: Column) -> Column:
    """``yyyy-MM-dd`` of a timestamp text; null for null or malformed text."""
    return F.date_format(F.try_to_timestamp(text), DAY)
