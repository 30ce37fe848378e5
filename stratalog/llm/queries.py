"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import fingerprints, jaccard_join, licenses, line_dedup, lm_scores, mixing, packing, pii, quality_rules, token_files


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: how many lines and words went, and the text left."""
    done = line_dedup.dedup(documents(spark, sf_dir, "doc_id", "text"), report=True)
    return done.select("doc_id", "n_lines", "n_deleted", "deleted_words", "text")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the contract's measurements, its base verdict, the
    ledger's mask and policy v1's verdict."""
    book = quality_rules.ledger(documents(spark, sf_dir, "doc_id", "text"))
    book = quality_rules.apply_policy(book, "v1").withColumn("base_failed", quality_rules.failed("base"))
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_alpha_words", "fail_mask")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS ks(k) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS BIGINT) AS n_alpha_words
  FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id),
r AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
          + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
          + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
          + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
          + CASE WHEN 100 * n_alpha_words < 60 * n_words THEN 16 ELSE 0 END
          + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 32 ELSE 0 END AS mask
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       mask & 3 <> 0 AS base_failed, mask & 63 = 0 AS kept, n_lines, n_alpha_words, CAST(mask AS BIGINT) AS fail_mask
FROM r
"""


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its block and slot; (slot, place) is the mixed order."""
    return mixing.schedule(documents(spark, sf_dir, "doc_id", "source", "text"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: fingerprints of its text and its edited text."""
    return fingerprints.with_edits(documents(spark, sf_dir, "doc_id", "text"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per licence wording found, with its place and differences."""
    return licenses.scan_documents(documents(spark, sf_dir, "doc_id", "text"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base and model log10 probability of its text."""
    return lm_scores.score(documents(spark, sf_dir, "doc_id", "text"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: base counts and digest, and all spans."""
    return pii.find(documents(spark, sf_dir, "doc_id", "text"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece, with its sequence and offset."""
    packed = packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its set's size and its component."""
    return jaccard_join.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, read back from the written files."""
    return token_files.round_trip(documents(spark, sf_dir, "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_fingerprints": op2_fingerprints,
        "op3_licenses": op3_licenses,
        "op4_lm_scores": op4_lm_scores,
        "op5_pii": op5_pii,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_line_dedup": op7_line_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_token_files": op10_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_quality_rules": OP8_SQL}
