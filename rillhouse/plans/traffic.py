"""Traffic dataflows over client logs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rillhouse.operators.routing import route_log
from rillhouse.operators.visits import fix_is_new
from rillhouse.sources.records import parse_log, split_log


def clean_log(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(log records, dirty text) of raw log text."""
    return split_log(parse_log(raw))


def log_outputs(raw: DataFrame, tz: str | None = None) -> dict[str, DataFrame]:
    """All outputs of the log split by name, dirty text included."""
    log, dirty = clean_log(raw)
    return {**route_log(fix_is_new(log, tz=tz)), "dirty": dirty}
