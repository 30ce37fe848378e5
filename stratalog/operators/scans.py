"""Ordered scans and projections of runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a tombstone prints as.
TOMBSTONE_TEXT = "Tombsome()"


def scan(entries: DataFrame, *mapped: Column | Callable[[], Column] | str, live_only: bool = False, descending: bool = False) -> DataFrame:
    """Entries in key order, projected by ``mapped`` (all columns if none).

    Sorting happens on the columns read only: a key scan reads no values.
    """
    rows = entries.where(is_live()) if live_only else entries
    columns = [m() if callable(m) and not isinstance(m, Column) else m for m in mapped]
    ordered = rows.orderBy(F.desc("key") if descending else F.asc("key"))
    return ordered.select(*columns) if columns else ordered


def key_values(entries: DataFrame) -> DataFrame:
    """(key, value) of live entries, in key order."""
    return scan(entries, "key", "value", live_only=True)


def keys(entries: DataFrame) -> DataFrame:
    """All keys, deleted ones included, in key order."""
    return scan(entries, "key")


def values(entries: DataFrame) -> DataFrame:
    """(value, is_tombstone) in key order, tombstones included."""
    return scan(entries, "value", "is_tombstone")


def entries_with_tombstones(entries: DataFrame) -> DataFrame:
    """(key, value, is_tombstone) in key order."""
    return scan(entries, "key", "value", "is_tombstone")


def is_live() -> Column:
    return ~F.col("is_tombstone")


def value_or_empty(value: str = "value") -> Column:
    """A value as bytes (or text); a tombstone is empty."""
    return F.when(F.col("is_tombstone"), F.lit("")).otherwise(F.col(value))


def value_text(value: str = "value") -> Column:
    """A value as text."""
    return F.when(F.col("is_tombstone"), F.lit(TOMBSTONE_TEXT)).otherwise(F.col(value).cast("string"))


def value_length(value: str = "value") -> Column:
    """Bytes of a value; 0 for a tombstone."""
    return F.when(F.col("is_tombstone"), F.lit(0)).otherwise(F.coalesce(F.octet_length(value), F.lit(0))).cast("long")
