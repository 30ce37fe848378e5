"""Intermediate tables in the shared folder, and numbering by ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir.

    The session names the shared folder. Where it is unset, a local one is made and
    set, which only a local master can share; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: later stages recompute from the written table if an
    executor is lost, and nothing depends on one machine's disk.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Delete the files under a table that cut() wrote, once nothing reads it."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def number_within(df: DataFrame, keys: list[str], order: list[str | Column], name: str, keep_part: bool = False) -> DataFrame:
    """Add ``name``: the row's place, from 0, among the rows of its key in the
    given order.

    Rows are dealt by ranges of (key, order), so a key with any share of the
    rows spreads over many tasks. Each range counts its own rows; only one count
    per range and key is summed up. The sorted ranges are a written table, so
    that places stay the same when a task is run again. ``keep_part`` keeps the
    range's number as ``__part``.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    ranged = cut(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}))
    counts = ranged.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    # A part holds few keys, so this join has no large group on either side.
    s = starts.select(*(F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys)), F.col("__part").alias("__p"), "__first", "__before")
    on = ranged["__part"] == s["__p"]
    for i, k in enumerate(keys):
        on = on & ranged[k].eqNullSafe(s[f"__key{i}"])
    return ranged.join(s, on, "inner").withColumn(name, F.col("__before") + F.col("__at") - F.col("__first")).select(*df.columns, name, *["__part"] * keep_part)


def count_before(df: DataFrame, order: str, flag: Column, name: str) -> tuple[DataFrame, int]:
    """Add ``name``: how many rows with ``flag`` come before the row in ``order``
    (unique values); and how many there are in all.

    Rows are dealt by ranges of ``order``; each range counts its own, and only one
    count per range is summed up, so that no range join is needed.
    """
    ranged = df.withColumn("__flag", flag.cast("long")).repartitionByRange(partitions(df.sparkSession), order)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.coalesce(F.sum("__flag"), F.lit(0)).alias("__n"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.join(starts, "__part").withColumn(name, F.col("__start") + F.coalesce(F.sum("__flag").over(within), F.lit(0)))
    total = ranged.agg(F.coalesce(F.sum("__flag"), F.lit(0))).first()[0]
    return counted.select(*df.columns, name), int(total)
