import random

import pytest
from model import Store
from pyspark.sql import functions as F

from stratalog.operators import log as ops
from stratalog.operators import merge, scans
from stratalog.schema import CHANGE_LOG, change_log, rows_as_log

LOG = "seq long, key string, value string, is_tombstone boolean, run_id long"


def random_log(seed, n=400, n_keys=12, flush=0.04):
    """Operations, and the store after each."""
    rng, rows, store, run, steps = random.Random(seed), [], Store(), 0, []
    for seq in range(n):
        key = rng.choice(["", "k", "k1", "é", *map(str, range(n_keys))])
        if rng.random() < 0.35:
            existed = store.delete(key)
            rows.append([seq, key, None, True, run])
        else:
            existed, value = None, rng.choice(["", "v", "long value", "ü" * rng.randrange(9)])
            store.put(key, value)
            rows.append([seq, key, value, False, run])
        steps.append((existed, store.size))
        if rng.random() < flush:
            store.flush()
            run += 1
    for row in rows:
        if row[4] == run:
            row[4] = None
    return rows, store, steps


@pytest.mark.parametrize("seed", range(3))
def test_reads_equal_the_sequential_store(spark, seed):
    rows, store, steps = random_log(seed)
    log = spark.createDataFrame(rows, LOG)
    keys = {r[1] for r in rows}
    for mode in ("intended", "observed"):
        want = {k: v for k in keys if (v := store.get(k, mode)) is not None}
        assert {r["key"]: r["value"] for r in ops.latest(log, mode).collect()} == want
        some = spark.createDataFrame([("k",), ("3",), ("absent",), ("3",)], "key string")
        assert {r["key"]: r["value"] for r in ops.multi_get(log, some, mode).collect()} == {k: v for k, v in want.items() if k in ("k", "3")}
    assert [r["existed"] for r in ops.delete_existed(log).orderBy("seq").collect()] == [e for e, _ in steps if e is not None]
    assert [r["size"] for r in ops.memtable_size(log).orderBy("seq").collect()] == [s for _, s in steps]
    assert {r["would_underflow"] for r in ops.memtable_size(log).where("size < 0").collect()} <= {True}


def test_flushed_entries_keep_what_a_generation_leaves(spark):
    rows, store, _ = random_log(7)
    log = spark.createDataFrame(rows, LOG)
    got = {(r["run_id"], r["key"]): r["value"] for r in ops.run_entries(log, "observed").collect()}
    want = {(i if i < len(store.runs) else None, k): v for i, run in enumerate([*store.runs, store.memory]) for k, v in run.items()}
    assert got == want
    assert ops.run_entries(log).count() >= len(want)


@pytest.mark.parametrize("max_bytes", [30, 200])
def test_cut_runs_follows_the_flush_rule(spark, max_bytes):
    rng, store, rows = random.Random(max_bytes), Store(max_bytes), []
    for seq in range(300):
        key, before = f"key{rng.randrange(9)}", len(store.runs)
        if rng.random() < 0.3:
            store.delete(key)
            rows.append([seq, key, None, True, before])
        else:
            value = "x" * rng.randrange(12)
            store.put(key, value)
            rows.append([seq, key, value, False, before])
    want = {r[0]: r[4] if r[4] < len(store.runs) else None for r in rows}
    log = spark.createDataFrame([[*r[:4], None] for r in rows], LOG)
    assert {r["seq"]: r["run_id"] for r in ops.cut_runs(log, max_bytes).collect()} == want
    sharded = ops.cut_runs(log, max_bytes, shards=3)
    assert sharded.count() == 300 and sharded.groupBy("run_id").agg(F.count_distinct(F.pmod(F.xxhash64(F.col("key").cast("binary")), F.lit(3))).alias("n")).where("run_id IS NOT NULL AND n > 1").count() == 0


def test_put_delete_flush_and_points(spark):
    log = spark.createDataFrame([], LOG)
    log = ops.put(ops.put(ops.put(log, 1, "key1", "value1"), 2, "key2", "value2"), 3, "key3", "value3")
    assert ops.memtable_size(log).orderBy(F.desc("seq")).first()["size"] == 30
    log = ops.delete(ops.flush(log, 0), 4, "key2")
    assert ops.get(log, "key2").collect() == [] and ops.get(log, "key2", "observed").first()["value"] == "value2"
    assert ops.get(log, "key1").first()["value"] == "value1" and ops.get(log, "nope").collect() == []
    at = spark.createDataFrame([(2, "key2"), (3, "key2"), (9, "key2"), (9, "zz")], "at_seq long, key string")
    assert {(r["at_seq"], r["key"]): r["value"] for r in ops.as_of(log, at).collect()} == {(2, "key2"): None, (3, "key2"): "value2", (9, "key2"): None, (9, "zz"): None}
    assert [r["key"] for r in ops.drain(log).collect()] == ["key2"]
    with pytest.raises(ValueError):
        ops.latest(log, "other")


def test_binary_keys_sort_as_unsigned_bytes_and_empty_differs_from_deleted(spark):
    keys = [b"", b"\x00", b"k", b"k1", b"\x7f", b"\x80", b"\xff"]
    rows = [(i, k, b"" if i % 2 else None, i % 2 == 0, 0) for i, k in enumerate(reversed(keys))]
    log = spark.createDataFrame(rows, CHANGE_LOG)
    entries = ops.run_entries(log)
    assert [bytes(r["key"]) for r in scans.keys(entries).collect()] == sorted(keys)
    assert [bytes(r["key"]) for r in scans.scan(entries, "key", descending=True).collect()] == sorted(keys, reverse=True)
    assert [bytes(r["value"]) for r in scans.key_values(entries).collect()] == [b""] * 3
    assert scans.values(entries).where("is_tombstone").count() == 4
    assert {r[0] for r in entries.where("is_tombstone").select(scans.value_text()).collect()} == {"Tombsome()"}
    assert ops.get(log, b"\x80").count() == 1


def test_merge_and_compaction(spark):
    def run(ids, run_id, value="v"):
        return spark.createDataFrame([(run_id, f"k{i}", f"{value}{i}", False, run_id * 100 + i) for i in ids], "run_id long, key string, value string, is_tombstone boolean, seq long")

    even, odd = run(range(0, 10, 2), 0), run(range(1, 10, 2), 1)
    assert [(r["key"], r["value"]) for r in merge.kway_merge([odd, even]).collect()] == [(f"k{i}", f"v{i}") for i in range(10)]
    twice = merge.kway_merge([even, even]).collect()
    assert [r["table_idx"] for r in twice] == [0, 1] * 5
    assert merge.compact(even.union(even)).count() == 5
    newer = run([2, 4], 2, "new")
    gone = spark.createDataFrame([(3, "k4", None, True, 304)], newer.schema)
    whole = even.union(odd).union(newer).union(gone)
    assert {r["key"]: r["value"] for r in merge.compact(whole).collect()}["k2"] == "new2"
    assert merge.compact(whole).where("is_tombstone").count() == 1 and merge.compact(whole, drop_tombstones=True).count() == 9
    assert sorted(map(tuple, merge.compact_late(whole).select("key", "run_id").collect())) == sorted(map(tuple, merge.compact(whole).select("key", "run_id").collect()))
    groups = {r["run_id"]: r["group_id"] for r in merge.FixedFanIn(2).choose(spark.createDataFrame([(i,) for i in (3, 5, 8, 9, 11)], "run_id long")).collect()}
    assert groups == {3: 0, 5: 0, 8: 1, 9: 1}


def test_adapters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, name string, n int")
    rows = rows_as_log(df, ["id", "name"], F.col("id")).collect()
    assert rows[0]["key"] == "1/a" and rows[0]["value"] == '{"id":1,"name":"a","n":5}'
    gone = change_log(df, F.col("id"), F.col("name"), F.col("n").cast("string"), F.col("n").isNull()).collect()
    assert [(r["value"], r["is_tombstone"]) for r in gone] == [("5", False), (None, True)]
