"""Expressions over change-record payloads, whose values all travel as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fields(payload: Column, *names: str) -> list[Column]:
    """One column per payload key; a missing key is null."""
    return [payload[n].alias(n) for n in names]


def whole(text: Column) -> Column:
    """Text as int, null when malformed."""
    return text.try_cast("int")


def amount(text: Column) -> Column:
    """Text as decimal(16,2), null when malformed."""
    return text.try_cast("decimal(16,2)")


def amount_product(a: Column, b: Column) -> Column:
    """Product of two amounts as text at scale 4."""
    return (amount(a) * amount(b)).cast("string")


def split_list(text: Column) -> Column:
    """Comma list as an array of trimmed names."""
    return F.transform(F.split(text, ","), lambda c: F.trim(c))
