import pytest

from stratalog.functions import layout
from stratalog.operators import log as ops
from stratalog.plans import commands, metrics
from stratalog.sources import raw_sstable
from stratalog.sources.runs import RunOptions, RunStore
from stratalog.streaming import ingest

ENTRIES = [(f"k{i}".encode(), None if i == 4 else f"v{i}".encode()) for i in range(10)]
LOG = "seq long, key string, value string, is_tombstone boolean, run_id long"


def test_raw_files(spark, tmp_path):
    data = raw_sstable.encode_run(ENTRIES)
    assert list(raw_sstable.decode_run(data)) == ENTRIES
    assert len(data) == sum(len(layout.encode_value(v)) + len(k) for k, v in ENTRIES) + 32 * 10 + 16
    path = tmp_path / "one.data"
    path.write_bytes(data)
    assert raw_sstable.number_of_keys(str(path)) == 10
    for k, v in ENTRIES:
        assert raw_sstable.lookup(str(path), k) == (True, v)
    for k in (b"k3a", b"a3a", b""):
        assert raw_sstable.lookup(str(path), k) == (False, None)
    empty = tmp_path / "empty.data"
    empty.write_bytes(raw_sstable.encode_run([]))
    assert raw_sstable.lookup(str(empty), b"k") == (False, None)
    with pytest.raises(ValueError):
        raw_sstable.encode_run([(b"b", b""), (b"a", b"")])


def test_raw_data_source(spark, tmp_path):
    spark.dataSource.register(raw_sstable.SSTableSource)
    df = spark.createDataFrame([(k, v, v is None) for k, v in ENTRIES], raw_sstable.SCHEMA)
    path = str(tmp_path / "runs")
    df.coalesce(1).sortWithinPartitions("key").write.format("sstable").mode("append").option("path", path).save()
    got = spark.read.format("sstable").option("path", path).load()
    assert [(bytes(r["key"]), None if r["value"] is None else bytes(r["value"])) for r in got.collect()] == ENTRIES
    lengths = layout.file_sizes(df.selectExpr("0L AS run_id", "key", "value", "is_tombstone")).first()
    assert lengths["total_bytes"] == len(raw_sstable.encode_run(ENTRIES))


def test_store_flush_compact_retire_vacuum(spark, tmp_path):
    store = RunStore(spark, str(tmp_path), RunOptions(bloom_filter=True))
    assert store.version() == 0 and store.manifest().count() == 0 and store.entries().count() == 0
    log = spark.createDataFrame([(1, "a", "1", False, None), (2, "b", "2", False, None)], LOG)
    assert store.flush(log) == 1
    assert store.flush(spark.createDataFrame([], LOG)) is None
    assert store.flush(spark.createDataFrame([(3, "a", None, True, None), (4, "c", "3", False, None)], LOG)) == 2
    live = {r["run_id"]: r.asDict() for r in store.live().collect()}
    assert live[2]["n_keys"] == 2 and live[2]["n_tombstones"] == 1 and bytes(live[1]["max_key"]) == b"b" and live[1]["created_seq"] == 2
    assert {r["key"]: r["value"] for r in ops.latest(store.entries()).collect()} == {"b": "2", "c": "3"}
    assert store.entries(key="c").select("run_id").distinct().count() == 1
    assert store.compact() == [3]
    assert [r["run_id"] for r in store.live().collect()] == [3]
    assert {r["key"]: r["value"] for r in ops.latest(store.entries()).collect()} == {"b": "2", "c": "3"}
    assert [r["run_id"] for r in store.load().collect()] == [1, 2, 3]
    assert sorted(store.vacuum()) == [1, 2] and [r["run_id"] for r in store.load().collect()] == [3]
    store.register(3)
    assert store.live().count() == 1
    store.retire([3])
    assert store.live().count() == 0
    with pytest.raises(Exception):
        store.write_run(ops.run_entries(log), 3)
    wide = RunStore(spark, str(tmp_path / "wide"), RunOptions(files_per_run=2))
    wide.flush(log)
    assert wide.entries().count() == 2


def test_commands(spark):
    rows = [(1, "SET", ["a", "1"]), (2, "GET", ["a"]), (3, "DEL", ["a"]), (4, "GET", ["a"]), (5, "DEL", ["x"]), (6, "FLUSHALL", ["now"]), (7, "get", ["a"]), (8, "SET", ["a"]), (9, "SET", ["b", ""]), (10, "GET", ["b"]), (11, "CONFIG", []), (12, "GET", ["b"])]
    df = spark.createDataFrame(rows, "seq long, cmd string, args array<string>")
    got = [(r["kind"], r["payload"]) for r in commands.replay(df).orderBy("seq").collect()]
    unknown = ("error", "Unknown command")
    assert got == [("bulk", "OK"), ("bulk", "1"), ("bulk", "OK"), ("null", None), ("bulk", "OK"), ("bulk", "OK"), unknown, unknown, ("bulk", "OK"), ("bulk", ""), unknown, ("bulk", "")]
    assert {r["seq"]: r["run_id"] for r in commands.as_log(df).collect()} == {1: 0, 3: 0, 5: 0, 9: None}
    assert tuple(metrics.read_metrics(df).first()) == (3, 1)
    log = commands.as_log(df)
    frame, seen = metrics.observed(log)
    frame.count()
    assert seen.get["tombstones"] == 2


def test_streams_equal_the_batch(spark, tmp_path):
    rows = [(i, str(i % 7), None if i % 5 == 0 else f"v{i}", i % 5 == 0, None) for i in range(60)]
    source = str(tmp_path / "in")
    whole = spark.createDataFrame(rows, LOG)
    for part in (rows[40:], rows[:20], rows[20:40]):  # out of order
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
    want = {r["key"]: r["value"] for r in ops.latest(whole).collect()}
    stream = ingest.latest_stream(ingest.read_log(spark, source, whole.schema, 1))
    stream.writeStream.format("memory").queryName("newest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r["key"]: r["value"] for r in spark.table("newest").where("NOT is_tombstone").collect()} == want
    store = RunStore(spark, str(tmp_path / "store"))
    write = ingest.flush_each_batch(store, compact_every=2)
    ingest.read_log(spark, source, whole.schema, 1).writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert {r["key"]: r["value"] for r in ops.latest(store.entries()).collect()} == want
    write(whole.limit(0), 0)  # a batch that was stored before
    assert {r["key"]: r["value"] for r in ops.latest(store.entries()).collect()} == want


def _flush(store, spark, *rows):
    return store.flush(spark.createDataFrame([(*r, None) for r in rows], LOG))


def test_dropped_tombstones_revive_nothing(spark, tmp_path):
    merges = []
    store = RunStore(spark, str(tmp_path), RunOptions(on_merge=lambda old, new: merges.append((old, new))))
    for row in ((1, "a", "1", False), (2, "b", "2", False), (3, "a", None, True), (4, "c", "3", False)):
        _flush(store, spark, row)
    store.compact(drop_tombstones=True)
    assert merges == [([1, 2], 5), ([3, 4], 6)]
    assert {r["key"]: r["value"] for r in ops.latest(store.entries()).collect()} == {"b": "2", "c": "3"}
    assert store.entries().where("is_tombstone").count() == 1
    # The next merge has everything and may drop it; an older merged run goes first.
    store.compact(drop_tombstones=True)
    assert {r["key"] for r in store.entries().collect()} == {"b", "c"}


def test_what_a_dead_writer_left_is_replaced(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    batch = spark.createDataFrame([(1, "a", "1", False, None)], LOG)
    write = ingest.flush_each_batch(store)
    run = tmp_path / "runs" / f"run_id={ingest.BATCH_STEP:020d}"
    run.mkdir(parents=True)
    (run / "part-0.parquet").write_bytes(b"torn")
    (tmp_path / "manifest" / "v=1").mkdir(parents=True)
    assert store.load().count() == 0 and store.version() == 0
    write(batch, 0)
    assert [(r["key"], r["value"]) for r in ops.latest(store.entries()).collect()] == [("a", "1")]
    assert store.load().count() == 1 and store.version() == 1


def test_a_batch_run_again_after_a_merge_stays_retired(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    write = ingest.flush_each_batch(store, compact_every=2)
    batches = [spark.createDataFrame([(i, "a", str(i), False, None)], LOG) for i in range(2)]
    for i, b in enumerate(batches):
        write(b, i)
    live = [r["run_id"] for r in store.live().collect()]
    write(batches[1], 1)
    assert [r["run_id"] for r in store.live().collect()] == live and len(live) == 1


def test_files_and_pointers(spark):
    df = spark.createDataFrame([(r, k, v, v is None) for r in (1, 2) for k, v in ENTRIES[:: 3 - r]], "run_id long, key binary, value binary, is_tombstone boolean")
    files = raw_sstable.encode_files(df)
    want = sorted((r["run_id"], bytes(r["key"]), r["is_tombstone"]) for r in df.collect())
    assert sorted((r["run_id"], bytes(r["key"]), r["is_tombstone"]) for r in raw_sstable.decode_files(files).collect()) == want
    found = raw_sstable.read_pointers(files, layout.pointers(df)).collect()
    assert sorted((r["run_id"], bytes(r["key"]), r["is_tombstone"]) for r in found) == want
    assert {(bytes(r["key"]), r["value"] and bytes(r["value"])) for r in found if r["run_id"] == 2} == set(ENTRIES)
