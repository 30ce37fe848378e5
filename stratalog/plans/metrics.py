"""Engine metrics from logs and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stratalog.operators.log import before, memtable_size, run_entries
from stratalog.plans.commands import verb
from stratalog.tables import count_before


def flush_metrics(log: DataFrame) -> DataFrame:
    """(run_id, flushed_bytes, n_keys, n_tombstones) of every closed generation."""
    closed = log.where("run_id IS NOT NULL")
    sizes = memtable_size(closed).groupBy("run_id").agg(F.max_by("size", "seq").alias("flushed_bytes"))
    entries = run_entries(closed).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_keys"), F.sum(F.col("is_tombstone").cast("long")).alias("n_tombstones"))
    return sizes.join(entries, "run_id")


def flush_totals(log: DataFrame) -> DataFrame:
    """One row: flushed_bytes and flushed_to_disk, the number of flushes."""
    per_run = flush_metrics(log)
    return per_run.agg(F.coalesce(F.sum("flushed_bytes"), F.lit(0)).alias("flushed_bytes"), F.count(F.lit(1)).alias("flushed_to_disk"))


def read_metrics(commands: DataFrame) -> DataFrame:
    """One row: GETs that the open generation answers, and all others.

    A GET counts as from memory if the newest operation of its key in the
    generation it falls into is a put.
    """
    rows, _ = count_before(commands.withColumn("verb", verb()), "seq", F.col("verb") == "FLUSHALL", "run")
    keyed = rows.where("verb IN ('SET', 'DEL', 'GET')").select("seq", "verb", "run", F.get("args", F.lit(0)).alias("key"))
    write = F.when(F.col("verb") != "GET", F.struct("run", (F.col("verb") == "SET").alias("put")))
    asked = keyed.withColumn("w", before(write, [F.col("seq")])).where("verb = 'GET'")
    hit = F.coalesce((F.col("w.run") == F.col("run")) & F.col("w.put"), F.lit(False))
    return asked.agg(F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("fetched_from_memory"), F.coalesce(F.sum((~hit).cast("long")), F.lit(0)).alias("fetched_from_disk"))


def observed(df: DataFrame, name: str = "engine") -> tuple[DataFrame, Observation]:
    """``df`` that counts rows and tombstones while an action runs over it."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.col("is_tombstone").cast("long")).alias("tombstones")), seen
