"""A command log replayed as one query.

A command is (seq, cmd, args); commands are SET k v, GET k, DEL k and FLUSHALL
(any arguments; it ends a generation). Names are upper case, the number of
arguments is exact, anything else is an unknown command. Replies are (seq, kind,
payload): bulk 'OK' or the value, null, or an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.operators.log import before
from stratalog.tables import count_before

UNKNOWN = "Unknown command"


def _is(name: str, n: int | None) -> Column:
    named = F.col("cmd") == name
    return named if n is None else named & (F.size("args") == n)


def verb() -> Column:
    """SET, GET, DEL, FLUSHALL, or null for an unknown command."""
    known = F.when(_is("SET", 2), "SET").when(_is("GET", 1), "GET").when(_is("DEL", 1), "DEL")
    return known.when(_is("FLUSHALL", None), "FLUSHALL")


def as_log(commands: DataFrame, generations: bool = True) -> DataFrame:
    """The change log of the commands. run_id: how many FLUSHALL came before; of
    the generation after the last one it is null."""
    rows, flushes = commands.withColumn("verb", verb()), 0
    run = F.lit(None).cast("long")
    if generations:
        rows, flushes = count_before(rows, "seq", F.col("verb") == "FLUSHALL", "run")
        run = F.when(F.col("run") < flushes, F.col("run"))
    value = F.when(F.col("verb") == "SET", F.get("args", F.lit(1)))
    return rows.where("verb IN ('SET', 'DEL')").select("seq", F.get("args", F.lit(0)).alias("key"), value.alias("value"), (F.col("verb") == "DEL").alias("is_tombstone"), run.alias("run_id"))


def replay(commands: DataFrame) -> DataFrame:
    """(seq, kind, payload) of every command, as a serial server answers.

    Commands without a key don't meet those of a key: they get a partition of
    their own kind by seq, so that unknown ones gather nowhere.
    """
    key = F.get("args", F.lit(0))
    rows = commands.withColumn("verb", verb()).withColumn("__key", F.when(F.col("verb").isin("SET", "GET", "DEL"), key))
    rows = rows.withColumn("__spread", F.when(F.col("__key").isNull(), F.col("seq")))
    written = F.when(F.col("verb").isin("SET", "DEL"), F.struct(F.when(F.col("verb") == "SET", F.get("args", F.lit(1))).alias("v"), F.lit(1).alias("set")))
    rows = rows.withColumn("__s", before(written, [F.col("seq")], ["__key", "__spread"]))
    text = F.when(F.col("verb") == "GET", F.col("__s.v")).when(F.col("verb").isNotNull(), F.lit("OK")).otherwise(F.lit(UNKNOWN))
    kind = F.when(F.col("verb").isNull(), "error").when((F.col("verb") == "GET") & F.col("__s.v").isNull(), "null").otherwise("bulk")
    return rows.select("seq", kind.alias("kind"), text.alias("payload"))
