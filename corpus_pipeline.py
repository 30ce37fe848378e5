"""A training corpus in five stages, each one of the operators.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and
returns a DataFrame; all but the last return the columns of ``docs``. ``run``
writes each result as Parquet in the shared folder and reads it again.

1. quality rules: documents that policy v1 rejects go.
2. line dedup: later copies of runs of lines (50 words or more) are deleted from
   the texts; documents with no word left go, n_chars follows the text.
3. n-gram Jaccard join: of each group of near duplicates, the row with the smallest
   doc_id stays (a null comes last; of rows that share it, the first by hash of the
   text). Groups are of rows, so rows that share a doc_id but no text all stay.
4. mixing: the rows in mixed order, as they are to be read.
5. best-fit packing: the pieces and their places in training sequences, which in
   ascending sequence_id follow the mixed order as far as the packing allows.

A table's rows have the order of its files' names (their numbers) and, in a file, of
its rows; stage 4 writes the mixed order so, and stage 5 reads it so.

Nulls, empty texts and tables, ties and clashing column names have the results
that the operators define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import jaccard_join, line_dedup, mixing, packing, quality_rules
from stratalog.llm.base import SPACE_CHARS, cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # In a struct, no column of the input can clash with a measurement.
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.col("text").alias("text"))
    return quality_rules.apply_policy(quality_rules.ledger(rows), "v1").where("kept").select("__row.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.where(F.length(F.trim(F.col("text"), F.lit(SPACE_CHARS))) > 0).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Ids of rows, written so that they stay the same; in a struct, no column of the
    # input can clash with them.
    rows = cut(docs.select(F.monotonically_increasing_id().alias("id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")))
    found = jaccard_join.near_duplicates(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")))
    groups = found.select(F.col("doc_id").alias("id"), F.col("component_id").alias("component"))
    order = F.struct(F.col("row.doc_id").isNull(), F.col("row.doc_id"), F.xxhash64("row.text"), F.col("id"))
    first = rows.select("id", order.alias("order")).join(groups, "id").groupBy("component").agg(F.min("order").alias("first"))
    return rows.join(first.select(F.col("first.id").alias("id")), "id", "left_semi").select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Where a row stands in the written mixture.
    at = docs.metadataColumn("_metadata")
    name = at.getField("file_name")
    order = F.struct(F.length(name).alias("digits"), name.alias("file"), at.getField("row_index").alias("row"))
    return packing.pack_documents(docs, order=order).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Packing and mixing can't be stated in SQL; tests/llm compares the stages with
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
