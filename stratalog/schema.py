"""Canonical schemas and adapters from ordinary tables to a change log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE_LOG = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("key", T.BinaryType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("is_tombstone", T.BooleanType(), False),
    T.StructField("run_id", T.LongType(), True),  # null: still in the open generation
])


def change_log(df: DataFrame, seq: Column, key: Column, value: Column, deleted: Column | None = None, run_id: Column | None = None) -> DataFrame:
    """A change log from any table. Keys and values keep the type they have
    (string or binary); an empty value isn't a tombstone, a deleted row has a
    null value."""
    gone = F.coalesce(deleted, F.lit(False)) if deleted is not None else F.lit(False)
    return df.select(
        seq.cast("long").alias("seq"),
        key.alias("key"),
        F.when(~gone, value).alias("value"),
        gone.alias("is_tombstone"),
        (run_id.cast("long") if run_id is not None else F.lit(None).cast("long")).alias("run_id"),
    )


def rows_as_log(df: DataFrame, keys: list[str], seq: Column) -> DataFrame:
    """Whole rows as values: the key is the key columns joined by '/', the value
    the row as JSON."""
    return change_log(df, seq, F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.to_json(F.struct("*")))
