"""Structured Streaming over change logs.

The newest operation by seq wins, so late and repeated rows do no harm and no
watermark is needed for right results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stratalog.sources.runs import RunStore


def read_log(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of change-log rows from Parquet files as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def latest_stream(log: DataFrame) -> DataFrame:
    """(key, value, is_tombstone, seq): each key's newest operation, for update
    or complete mode. The aggregate is combined before the shuffle."""
    newest = F.max_by(F.struct("value", "is_tombstone"), "seq").alias("s")
    return log.groupBy("key").agg(newest, F.max("seq").alias("seq")).select("key", "s.value", "s.is_tombstone", "seq")


class _Newest(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "seq long, value string, is_tombstone boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        best = self.state.get() if self.state.exists() else None
        for frame in rows:
            i = int(frame["seq"].to_numpy().argmax())
            seq = int(frame["seq"].iloc[i])
            if best is None or seq > best[0]:
                value = frame["value"].iloc[i]
                best = (seq, None if pd.isna(value) else value, bool(frame["is_tombstone"].iloc[i]))
        self.state.update(best)
        yield pd.DataFrame({"key": [key[0]], "value": [best[1]], "is_tombstone": [best[2]], "seq": [best[0]]})

    def close(self) -> None:
        pass


def latest_stateful(log: DataFrame) -> DataFrame:
    """The same with one explicit state per key (needs the RocksDB state store)."""
    return log.groupBy("key").transformWithStateInPandas(_Newest(), "key string, value string, is_tombstone boolean, seq long", "Update", "None")


#: Ids from one batch to the next; merges of a batch fit between.
BATCH_STEP = 1_000_000


def flush_each_batch(store: RunStore, compact_every: int = 0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch becomes a run; every so many batches,
    runs are merged. A run's id follows from the batch's number, so a batch that
    is run again after a failure isn't stored twice, its remains are replaced, and
    one that a merge has taken in stays retired; merged runs take ids between
    batches' (see BATCH_STEP)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from stratalog.operators.log import run_entries

        run_id = BATCH_STEP * (batch_id + 1)
        known = {r["run_id"] for r in store.load().collect()}
        if run_id not in known:
            entries = run_entries(batch.withColumn("run_id", F.lit(None).cast("long")))
            if not entries.isEmpty():
                store.write_run(entries, run_id)
                known.add(run_id)
        if run_id in known:
            store.register(run_id)
        if compact_every and (batch_id + 1) % compact_every == 0:
            store.compact()

    return write
