"""Registered queries against their SQL, and the entry's guard."""

import importlib
import sys
import warnings

import duckdb
import pytest

import __spark_entry__ as entry
from stratalog import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(cursor_rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in cursor_rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sql, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(df.select(*columns).collect())
    query = registry.oracle_sql()[name]
    assert sorted(sql.sql(query).columns) == columns
    assert got == rows(sql.sql(f"SELECT {', '.join(columns)} FROM ({query})").fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_point_reads_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from stratalog.operators import log as ops

    log = spark.read.parquet(f"{SF}/orders.parquet").select(F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("key"), F.col("o_orderpriority").alias("value"), F.lit(False).alias("is_tombstone"))
    plan = ops.get(log, "F")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in plan


@pytest.mark.parametrize("missing", ["corpus_pipeline", "stratalog.llm", "xxhash"])
def test_entry_works_without_the_llm_part(monkeypatch, missing):
    """Also where a library is missing that only that part needs."""
    for name in [m for m in sys.modules if m.startswith(("stratalog.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    before = sys.modules.pop("__spark_entry__")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            alone = importlib.import_module("__spark_entry__")
        assert "lsm_latest" in alone.queries() and not any(q.startswith("op") or q == "pipeline" for q in alone.queries())
        assert set(alone.oracle_sql()) <= set(alone.queries())
    finally:
        sys.modules["__spark_entry__"] = before


@pytest.mark.parametrize("name", ["lsm_command_log", "lsm_read_metrics"])
def test_generations_need_no_nested_loop(spark, name):
    df = entry.queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
