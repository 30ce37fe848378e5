"""Where every key and value of a run lies in the raw file format.

File: values in key order (live: 1 byte 0x01, 8 bytes length, the bytes;
tombstone: 1 byte 0x00), keys in order without separators, the number of entries
(8 bytes), for each entry key position, key length, value position and value
length (8 bytes each), and last the position of the number of entries. Numbers
are little-endian and unsigned.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIVE_HEADER, POINTERS, NUMBER = 9, 32, 8


def encoded_length(value: str = "value") -> Column:
    """Bytes of an encoded value."""
    return F.when(F.col("is_tombstone"), F.lit(1)).otherwise(F.lit(LIVE_HEADER) + F.coalesce(F.octet_length(value), F.lit(0))).cast("long")


def pointers(entries: DataFrame) -> DataFrame:
    """(run_id, key, key_pos, key_len, val_pos, val_len) of every entry.

    Prefix sums run within a run; a run's size is bounded by the flush threshold
    and the compaction's fan-in.
    """
    ahead = Window.partitionBy("run_id").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("run_id")
    sized = entries.select("run_id", "key", F.octet_length("key").cast("long").alias("key_len"), encoded_length().alias("val_len"))
    return sized.select(
        "run_id",
        "key",
        (F.sum("val_len").over(whole) + F.coalesce(F.sum("key_len").over(ahead), F.lit(0))).alias("key_pos"),
        "key_len",
        F.coalesce(F.sum("val_len").over(ahead), F.lit(0)).alias("val_pos"),
        "val_len",
    )


def file_sizes(entries: DataFrame) -> DataFrame:
    """(run_id, n_keys, footer_pos, total_bytes) of every run's file."""
    sizes = entries.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(encoded_length() + F.octet_length("key")).cast("long").alias("footer_pos"))
    return sizes.select("run_id", "n_keys", "footer_pos", (F.col("footer_pos") + POINTERS * F.col("n_keys") + 2 * NUMBER).alias("total_bytes"))


def encode_value(value: bytes | None) -> bytes:
    """None is a tombstone."""
    return b"\x00" if value is None else b"\x01" + struct.pack("<Q", len(value)) + value


def decode_value(data: bytes) -> bytes | None:
    if data[:1] == b"\x00":
        return None
    if data[:1] != b"\x01":
        raise ValueError("a value begins with 0 or 1")
    (n,) = struct.unpack_from("<Q", data, 1)
    return data[LIVE_HEADER : LIVE_HEADER + n]


def encode_pointer(position: int, length: int) -> bytes:
    return struct.pack("<QQ", position, length)


def decode_pointer(data: bytes) -> tuple[int, int]:
    return struct.unpack("<QQ", data)


@F.pandas_udf(T.BinaryType())
def value_bytes(value: pd.Series, gone: pd.Series) -> pd.Series:
    """Encoded values, in Arrow batches."""
    as_bytes = lambda v: v.encode() if isinstance(v, str) else bytes(v or b"")
    return pd.Series([encode_value(None if g else as_bytes(v)) for v, g in zip(value, gone)])


@F.pandas_udf(T.BinaryType())
def pointer_bytes(position: pd.Series, length: pd.Series) -> pd.Series:
    return pd.Series([encode_pointer(int(p), int(n)) for p, n in zip(position, length)])
