"""Queries that answer for the whole log, on sf0.01 with its five generations."""

import duckdb
import pytest

import __spark_entry__ as entry
from stratalog import registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


def both(spark, sql, name):
    """Rows of a query, after comparing them with its SQL."""
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    want = sql.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return [dict(zip(columns, r)) for r in got]


@pytest.mark.parametrize("name", ["lsm_scan_live", "lsm_scan_keys", "lsm_scan_entries"])
def test_scans_read_every_generation(spark, sql, name):
    assert {r["run_id"] for r in both(spark, sql, name)} == set(range(5))


def test_drain_reads_the_whole_log(spark, sql):
    ((keys,),) = sql.sql("SELECT count(DISTINCT user_id) FROM events").fetchall()
    got = both(spark, sql, "lsm_drain")
    assert [r["key"] for r in sorted(got, key=lambda r: r["nth"])] == sorted({r["key"] for r in got}) and len(got) == keys


def test_bit_strings_have_every_width(spark, sql):
    got = both(spark, sql, "ts_bit_strings")
    ((events,),) = sql.sql("SELECT count(*) FROM events").fetchall()
    assert len(got) == events and {len(r["padded"]) for r in got} == {64, 128}
    assert all(len(r["padded"]) == 128 for r in got if r["bits"].startswith("111110"))


def test_every_event_is_asked_for(spark, sql):
    got = both(spark, sql, "lsm_replay_get")
    ((events,),) = sql.sql("SELECT count(*) FROM events").fetchall()
    assert len({r["at_seq"] for r in got}) == len(got) == events
