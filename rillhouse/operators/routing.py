"""Routing of log records into page, start, display, action and error rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("mid", "is_new", "seq")


def error_rows(log: DataFrame) -> DataFrame:
    """Records with an error, whole."""
    return log.where("err is not null")


def start_rows(log: DataFrame) -> DataFrame:
    """App starts, without the error part. They yield no other rows but errors."""
    return log.where("start is not null").drop("err")


def _items(log: DataFrame, source: str, name: str) -> DataFrame:
    """One row per array element, with the record's common part, page and time."""
    item = F.explode(source).alias(name)
    return log.where("start is null").select(*KEYS, item, "common", "page", "ts")


def display_rows(log: DataFrame) -> DataFrame:
    """One row per displayed item."""
    return _items(log, "displays", "display")


def action_rows(log: DataFrame) -> DataFrame:
    """One row per user action."""
    return _items(log, "actions", "action")


def page_rows(log: DataFrame) -> DataFrame:
    """Page views, without the error, display and action parts."""
    return log.where("start is null").drop("err", "start", "displays", "actions")


def route_log(log: DataFrame) -> dict[str, DataFrame]:
    """The five outputs over one parsed frame."""
    return {
        "page": page_rows(log),
        "start": start_rows(log),
        "display": display_rows(log),
        "action": action_rows(log),
        "error": error_rows(log),
    }


# Parts of a record that appear in its JSON text, in order.
JSON_PARTS = ("common", "page", "start", "err", "display", "displays", "action", "actions", "ts")


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON text in ``value``; absent parts are left out."""
    parts = [c for c in JSON_PARTS if c in rows.columns]
    return rows.withColumn("value", F.to_json(F.struct(*parts)))
