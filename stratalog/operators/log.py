"""Writes, reads and flushes of a change log.

A log has one row per put or delete: (seq, key, value, is_tombstone, run_id);
seq is a total order, run_id the generation that was flushed together, null while
it is open. Two ways to read: "intended" (the newest operation of a key decides,
a tombstone hides what is older) and "observed" (within a generation the newest
operation decides and a delete removes what it finds there; between generations
the open one comes first, then the oldest run, and a tombstone hides nothing).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Newest = "__nth"


def put(log: DataFrame, seq: int, key, value) -> DataFrame:
    """The log with one more put, in the open generation."""
    return _append(log, seq, key, value, False)


def delete(log: DataFrame, seq: int, key) -> DataFrame:
    """The log with one more delete; a delete is always recorded."""
    return _append(log, seq, key, None, True)


def _append(log: DataFrame, seq: int, key, value, gone: bool) -> DataFrame:
    kinds = ", ".join(f"{n} {log.schema[n].dataType.simpleString()}" for n in ("seq", "key", "value", "is_tombstone", "run_id"))
    row = log.sparkSession.createDataFrame([(seq, key, value, gone, None)], kinds)
    return log.unionByName(row)


def newest(log: DataFrame, by: list[str] | None = None, order: list[Column] | None = None) -> DataFrame:
    """The last operation of each key (or of each ``by``), tombstones included.

    row_number = 1 lets Spark drop all but one row of a key in each task before
    the shuffle, so a key with any share of the operations moves few rows.
    """
    nth = F.row_number().over(Window.partitionBy(*(by or ["key"])).orderBy(*(order or [F.desc("seq")])))
    return log.withColumn(Newest, nth).where(F.col(Newest) == 1).drop(Newest)


def latest(log: DataFrame, mode: str = "intended") -> DataFrame:
    """(key, value) of every live key."""
    if mode == "intended":
        return newest(log).where(~F.col("is_tombstone")).select("key", "value")
    if mode != "observed":
        raise ValueError(f"unknown mode {mode!r}")
    inside = newest(log, ["run_id", "key"]).where(~F.col("is_tombstone"))
    return newest(inside, ["key"], [F.asc_nulls_first("run_id")]).select("key", "value")


def get(log: DataFrame, key, mode: str = "intended") -> DataFrame:
    """One row (key, value) or none; the equality reaches the scan."""
    return latest(log.where(F.col("key") == F.lit(key)), mode)


def multi_get(log: DataFrame, keys: DataFrame, mode: str = "intended") -> DataFrame:
    """(key, value) of the live ones among ``keys`` (a column ``key``).

    Spark broadcasts the keys if their size is below its threshold, and else
    joins by shuffle.
    """
    return latest(log.join(keys.select("key").distinct(), "key", "left_semi"), mode)


def as_of(log: DataFrame, at: DataFrame) -> DataFrame:
    """For each row (at_seq, key): the value live just before at_seq, or null."""
    asked = at.select(F.col("at_seq").alias("seq"), "key", F.lit(None).cast(log.schema["value"].dataType).alias("value"), F.lit(False).alias("is_tombstone"), F.lit(True).alias("__asks"))
    both = log.select("seq", "key", "value", "is_tombstone", F.lit(False).alias("__asks")).unionByName(asked)
    state = before(F.when(~F.col("__asks"), F.struct("value", "is_tombstone")), [F.col("seq"), F.desc("__asks")])
    return both.withColumn("__s", state).where("__asks").select(F.col("seq").alias("at_seq"), "key", F.when(~F.col("__s.is_tombstone"), F.col("__s.value")).alias("value"))


def before(state: Column, order: list[Column], by: list[str] | None = None) -> Column:
    """The last non-null ``state`` among a key's earlier rows."""
    window = Window.partitionBy(*(by or ["key"])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(state, ignorenulls=True).over(window)


def delete_existed(log: DataFrame) -> DataFrame:
    """(seq, key, existed) of every delete: whether its generation had a put of
    the key before, deleted since or not."""
    earlier = Window.partitionBy("run_id", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    puts = F.coalesce(F.sum((~F.col("is_tombstone")).cast("int")).over(earlier), F.lit(0))
    return log.withColumn("existed", puts > 0).where("is_tombstone").select("seq", "key", "existed")


def _bytes(c: str) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def memtable_size(log: DataFrame) -> DataFrame:
    """(run_id, seq, size, retained, would_underflow) after every operation.

    ``size`` is the accounting that decides flushes: the first put of a key adds
    key and value, later puts nothing; a delete adds one and takes off the value
    it finds. It is signed; ``would_underflow`` marks where it is below zero.
    ``retained`` is what a generation truly holds: keys, and values that live.
    """
    key = Window.partitionBy("run_id", "key").orderBy("seq")
    ahead = key.rowsBetween(Window.unboundedPreceding, -1)
    is_put = ~F.col("is_tombstone")
    puts = F.coalesce(F.sum(is_put.cast("int")).over(ahead), F.lit(0))
    found = F.when(F.coalesce(F.lag(is_put).over(key), F.lit(False)), F.coalesce(F.lag(_bytes("value")).over(key), F.lit(0))).otherwise(F.lit(0))
    change = F.when(is_put, F.when(puts == 0, _bytes("key") + _bytes("value")).otherwise(0)).otherwise(1 - found)
    first = F.row_number().over(key) == 1
    held = F.when(first, _bytes("key")).otherwise(0) + F.when(is_put, _bytes("value")).otherwise(0) - found
    rows = log.select("run_id", "seq", change.cast("long").alias("__change"), held.cast("long").alias("__held"))
    so_far = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.sum("__change").over(so_far)
    return rows.select("run_id", "seq", size.alias("size"), F.sum("__held").over(so_far).alias("retained"), (size < 0).alias("would_underflow"))


def run_entries(log: DataFrame, mode: str = "intended") -> DataFrame:
    """What flushing each generation leaves: the newest operation of each key.

    "observed": keys that a generation only deleted leave nothing.
    """
    if mode == "observed":
        put_here = F.max((~F.col("is_tombstone")).cast("int")).over(Window.partitionBy("run_id", "key"))
        log = log.withColumn("__put", put_here).where("__put = 1").drop("__put")
    return newest(log, ["run_id", "key"]).select("run_id", "key", "value", "is_tombstone", "seq")


def flush(log: DataFrame, run_id: int) -> DataFrame:
    """The log with its open generation closed as ``run_id``."""
    return log.withColumn("run_id", F.coalesce("run_id", F.lit(run_id).cast("long")))


def drain(log: DataFrame) -> DataFrame:
    """(key, value, is_tombstone) of the open generation, sorted by key."""
    return newest(log.where("run_id IS NULL")).select("key", "value", "is_tombstone").orderBy("key")


def cut_runs(log: DataFrame, max_bytes: int = 1_024_000, shards: int = 1) -> DataFrame:
    """Set run_id by the flush rule: a generation ends with the operation after
    which its accounted size reaches ``max_bytes``; the rest stays open (null).

    The rule is sequential over all keys. With ``shards`` > 1 the key space is
    split by hash and each shard cuts its own runs, numbered shard + k * shards,
    in parallel; one shard is the exact single store. Only sizes pass through the
    sequential part; values are joined back by seq.
    """
    sized = log.select("seq", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("long").alias("shard"), F.col("key").cast("binary").alias("key"), _bytes("value").alias("n"), "is_tombstone")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, size, run = None, {}, 0, 0
        for rows in batches:
            out = []
            for s, seq, key, n, gone in zip(rows["shard"], rows["seq"], rows["key"], rows["n"], rows["is_tombstone"]):
                if s != shard:
                    shard, held, size, run = s, {}, 0, 0
                key = bytes(key)
                if gone:
                    size += 1 - (held[key] or 0 if key in held else 0)
                    if key in held:
                        held[key] = None
                else:
                    if key not in held:
                        size += len(key) + n
                    held[key] = n
                out.append((seq, shard + run * shards))
                if size >= max_bytes:
                    held, size, run = {}, 0, run + 1
            yield pd.DataFrame(out, columns=["seq", "run"])

    dealt = sized.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "seq")
    runs = dealt.select("shard", "seq", "key", "n", "is_tombstone").mapInPandas(cut, "seq long, run long")
    cut_log = log.drop("run_id").join(runs, "seq").withColumn("__shard", F.pmod(F.col("run"), F.lit(shards)))
    # The last generation of a shard is still open unless its size was reached.
    state = memtable_size(cut_log.withColumn("run_id", F.col("run"))).groupBy(F.col("run_id").alias("run")).agg(F.max_by("size", "seq").alias("__size"))
    closed = state.where(F.col("__size") >= max_bytes).select("run", F.lit(True).alias("__closed"))
    return cut_log.join(closed, "run", "left").select("seq", "key", "value", "is_tombstone", F.when(F.col("__closed"), F.col("run")).alias("run_id"))
