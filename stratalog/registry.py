"""Registered queries of the key-value engine and their SQL.

The log is ``events``: seq is event_id, the key user_id as text, an 'error' event
deletes, any other puts its type; 2,000 events are a generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions import bits, codec, layout
from stratalog.operators import log as ops
from stratalog.operators import merge, scans
from stratalog.plans import commands as plans
from stratalog.plans import metrics
from stratalog.schema import change_log
from stratalog.sources import raw_sstable
from stratalog.sources.runs import RunStore
from stratalog.tables import number_within, scratch

GENERATION = 2_000


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    return change_log(events, F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type"), F.col("event_type") == "error", F.expr(f"event_id div {GENERATION}"))


def events_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command log: most events write, every seventh reads, every 997th flushes,
    every 101st is misspelt."""
    k, e = F.col("user_id").cast("string"), F.col("event_id")
    cmd = F.when(e % 997 == 996, "FLUSHALL").when(e % 101 == 100, "set").when(e % 7 == 3, "GET").when(F.col("event_type") == "error", "DEL").otherwise("SET")
    args = F.when(cmd == "FLUSHALL", F.array().cast("array<string>")).when(cmd == "SET", F.array(k, F.col("event_type"))).otherwise(F.array(k))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(e.alias("seq"), cmd.alias("cmd"), args.alias("args"))


def events_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("value"))


LOG = f"""log AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_type <> 'error' THEN event_type END AS value,
         event_type = 'error' AS is_tombstone, event_id // {GENERATION} AS run_id
  FROM events)"""
ENTRIES = LOG + """,
entries AS (
  SELECT run_id, key, value, is_tombstone, seq FROM log
  QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1)"""
COMMANDS = """commands AS (
  SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS key, event_type AS value,
         CASE WHEN event_id % 997 = 996 THEN 'FLUSHALL' WHEN event_id % 101 = 100 THEN 'set' WHEN event_id % 7 = 3 THEN 'GET'
              WHEN event_type = 'error' THEN 'DEL' ELSE 'SET' END AS cmd
  FROM events)"""
SERIES = """series AS (SELECT user_id, event_id, epoch_us(ts) AS value FROM events),
deltas AS (
  SELECT *, value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS delta FROM series),
dods AS (
  SELECT *, delta - coalesce(lag(delta) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS dod FROM deltas),
coded AS (
  SELECT *, CASE WHEN dod = 0 THEN 0 WHEN dod BETWEEN -31 AND 63 THEN 1 WHEN dod BETWEEN -127 AND 255 THEN 2
                 WHEN dod BETWEEN -16383 AND 32767 THEN 3 WHEN dod BETWEEN -1073741823 AND 2147483647 THEN 4 ELSE 5 END AS b
  FROM dods)"""

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def _index(df: DataFrame, *order: str) -> DataFrame:
    """A column ``nth``: the row's place in the order, numbered by ranges."""
    return number_within(df, [], list(order), "nth")


LATEST = f"WITH {LOG}, last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"


@_query(f"{LATEST} SELECT key, value FROM last WHERE NOT is_tombstone")
def lsm_latest(spark, sf_dir):
    return ops.latest(events_log(spark, sf_dir))


@_query(f"{LATEST} SELECT key, value FROM last WHERE NOT is_tombstone AND key = '7'")
def lsm_get_point(spark, sf_dir):
    return ops.get(events_log(spark, sf_dir), "7")


@_query(f"{LATEST} SELECT key, value FROM last WHERE NOT is_tombstone AND key IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)")
def lsm_multi_get(spark, sf_dir):
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"))
    return ops.multi_get(events_log(spark, sf_dir), keys)


@_query(f"""WITH {ENTRIES}
SELECT key, value FROM entries WHERE NOT is_tombstone QUALIFY row_number() OVER (PARTITION BY key ORDER BY run_id) = 1""")
def lsm_observed_get(spark, sf_dir):
    return ops.latest(events_log(spark, sf_dir), "observed")


@_query(f"""WITH {LOG} SELECT seq AS at_seq, key, last_value(value) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS value
FROM log""")
def lsm_replay_get(spark, sf_dir):
    """The state just before each event."""
    log = events_log(spark, sf_dir)
    return ops.as_of(log, log.select(F.col("seq").alias("at_seq"), "key"))


@_query(f"""WITH {COMMANDS}, w AS (
  SELECT *, last_value(CASE WHEN cmd IN ('SET', 'DEL') THEN {{'v': CASE WHEN cmd = 'SET' THEN value END}} END IGNORE NULLS)
            OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s
  FROM commands)
SELECT seq, CASE WHEN cmd = 'set' THEN 'error' WHEN cmd = 'GET' AND s.v IS NULL THEN 'null' ELSE 'bulk' END AS kind,
       CASE WHEN cmd = 'set' THEN 'Unknown command' WHEN cmd = 'GET' THEN s.v ELSE 'OK' END AS payload
FROM w""")
def lsm_command_reply(spark, sf_dir):
    return plans.replay(events_commands(spark, sf_dir))


@_query(f"""WITH {COMMANDS}, f AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS run FROM commands WHERE cmd = 'FLUSHALL')
SELECT c.seq, c.key, CASE WHEN cmd = 'SET' THEN value END AS value, cmd = 'DEL' AS is_tombstone, (SELECT min(run) FROM f WHERE f.seq > c.seq) AS run_id
FROM commands c WHERE cmd IN ('SET', 'DEL')""")
def lsm_command_log(spark, sf_dir):
    return plans.as_log(events_commands(spark, sf_dir))


@_query(f"""WITH {LOG}, w AS (
  SELECT *, count(*) FILTER (NOT is_tombstone) OVER (PARTITION BY run_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM log)
SELECT seq, key, n > 0 AS existed FROM w WHERE is_tombstone""")
def lsm_delete_existed(spark, sf_dir):
    return ops.delete_existed(events_log(spark, sf_dir))


MEMTABLE = f"""WITH {LOG}, w AS (
  SELECT *, count(*) FILTER (NOT is_tombstone) OVER k AS puts, lag(value) OVER (PARTITION BY run_id, key ORDER BY seq) AS prev,
         row_number() OVER (PARTITION BY run_id, key ORDER BY seq) AS nth
  FROM log WINDOW k AS (PARTITION BY run_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (
  SELECT run_id, seq,
         CASE WHEN NOT is_tombstone THEN CASE WHEN puts = 0 THEN length(key) + length(value) ELSE 0 END ELSE 1 - coalesce(length(prev), 0) END AS change,
         CASE WHEN nth = 1 THEN length(key) ELSE 0 END + coalesce(length(value), 0) - coalesce(length(prev), 0) AS held
  FROM w),
sized AS (
  SELECT run_id, seq, CAST(sum(change) OVER s AS BIGINT) AS size, CAST(sum(held) OVER s AS BIGINT) AS retained
  FROM c WINDOW s AS (PARTITION BY run_id ORDER BY seq))"""


@_query(f"{MEMTABLE} SELECT *, size < 0 AS would_underflow FROM sized")
def lsm_memtable_size(spark, sf_dir):
    return ops.memtable_size(events_log(spark, sf_dir))


@_query(f"WITH {ENTRIES} SELECT * FROM entries")
def lsm_run_entries(spark, sf_dir):
    return ops.run_entries(events_log(spark, sf_dir))


@_query(f"""WITH {ENTRIES} SELECT * FROM entries e
WHERE EXISTS (SELECT 1 FROM log l WHERE l.run_id = e.run_id AND l.key = e.key AND NOT l.is_tombstone)""")
def lsm_run_entries_observed(spark, sf_dir):
    return ops.run_entries(events_log(spark, sf_dir), "observed")


@_query(f"{LATEST} SELECT key, value, is_tombstone, row_number() OVER (ORDER BY key) - 1 AS nth FROM last")
def lsm_drain(spark, sf_dir):
    """The whole log as one open generation."""
    return _index(ops.drain(events_log(spark, sf_dir).withColumn("run_id", F.lit(None).cast("long"))), "key")


@_query(f"WITH {ENTRIES} SELECT run_id, key, value, row_number() OVER (ORDER BY run_id, key) - 1 AS nth FROM entries WHERE NOT is_tombstone")
def lsm_scan_live(spark, sf_dir):
    return _index(ops.run_entries(events_log(spark, sf_dir)).where(scans.is_live()).select("run_id", "key", "value"), "run_id", "key")


@_query(f"WITH {ENTRIES} SELECT run_id, key, row_number() OVER (ORDER BY run_id, key) - 1 AS nth FROM entries")
def lsm_scan_keys(spark, sf_dir):
    return _index(ops.run_entries(events_log(spark, sf_dir)).select("run_id", "key"), "run_id", "key")


@_query(f"WITH {ENTRIES} SELECT run_id, key, value, is_tombstone, row_number() OVER (ORDER BY run_id, key) - 1 AS nth FROM entries")
def lsm_scan_entries(spark, sf_dir):
    return _index(ops.run_entries(events_log(spark, sf_dir)).select("run_id", "key", "value", "is_tombstone"), "run_id", "key")


@_query(f"WITH {ENTRIES} SELECT value, is_tombstone, row_number() OVER (ORDER BY run_id, key) - 1 AS nth FROM entries")
def lsm_scan_values(spark, sf_dir):
    return _index(ops.run_entries(events_log(spark, sf_dir)).select("run_id", "key", "value", "is_tombstone"), "run_id", "key").select("value", "is_tombstone", "nth")


@_query(f"WITH {ENTRIES} SELECT key, run_id, upper(value) AS shout FROM entries")
def lsm_scan_mapped(spark, sf_dir):
    """A scan with a mapper of its own, newest key first."""
    return scans.scan(ops.run_entries(events_log(spark, sf_dir)), "key", "run_id", lambda: F.upper("value").alias("shout"), descending=True)


@_query(f"""WITH {LOG} SELECT seq, CASE WHEN is_tombstone THEN 'Tombsome()' ELSE value END AS text, coalesce(value, '') AS bytes,
       CAST(coalesce(strlen(value), 0) AS BIGINT) AS len FROM log""")
def lsm_value_text_len(spark, sf_dir):
    return events_log(spark, sf_dir).select("seq", scans.value_text().alias("text"), scans.value_or_empty().alias("bytes"), scans.value_length().alias("len"))


@_query(f"""WITH {ENTRIES} SELECT key, value, is_tombstone, run_id AS table_idx, row_number() OVER (ORDER BY key, run_id) - 1 AS nth FROM entries""")
def lsm_kway_merge(spark, sf_dir):
    entries = ops.run_entries(events_log(spark, sf_dir)).withColumn("table_idx", F.col("run_id"))
    return _index(merge.kway_merge(entries).select("key", "value", "is_tombstone", "table_idx"), "key", "table_idx")


@_query(f"""WITH {ENTRIES}, runs AS (SELECT DISTINCT run_id FROM entries), r AS (SELECT run_id, row_number() OVER (ORDER BY run_id) - 1 AS rank, count(*) OVER () AS n FROM runs)
SELECT run_id, rank // 2 AS group_id FROM r WHERE rank < n // 2 * 2""")
def lsm_compact_groups(spark, sf_dir):
    return merge.FixedFanIn(2).choose(ops.run_entries(events_log(spark, sf_dir)).select("run_id").distinct())


@_query(f"""WITH {ENTRIES}, runs AS (SELECT DISTINCT run_id FROM entries), r AS (SELECT run_id, row_number() OVER (ORDER BY run_id) - 1 AS rank, count(*) OVER () AS n FROM runs),
g AS (SELECT run_id, rank // 2 AS group_id FROM r WHERE rank < n // 2 * 2)
SELECT group_id, key, value, is_tombstone, run_id FROM entries JOIN g USING (run_id) QUALIFY row_number() OVER (PARTITION BY group_id, key ORDER BY run_id DESC) = 1""")
def lsm_compact(spark, sf_dir):
    entries = ops.run_entries(events_log(spark, sf_dir))
    groups = merge.FixedFanIn(2).choose(entries.select("run_id").distinct())
    return merge.compact(entries, groups).select("group_id", "key", "value", "is_tombstone", "run_id")


@_query(f"WITH {ENTRIES} SELECT key, value, is_tombstone, run_id FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY run_id DESC) = 1")
def lsm_compact_late(spark, sf_dir):
    return merge.compact_late(ops.run_entries(events_log(spark, sf_dir))).select("key", "value", "is_tombstone", "run_id")


@_query(f"""WITH {ENTRIES}, m AS (SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY key ORDER BY run_id DESC) = 1)
SELECT key, value, run_id FROM m WHERE NOT is_tombstone""")
def lsm_tombstone_gc(spark, sf_dir):
    return merge.compact(ops.run_entries(events_log(spark, sf_dir)), drop_tombstones=True).select("key", "value", "run_id")


@_query(f"""WITH {ENTRIES}, e AS (SELECT run_id, key, strlen(key) AS kl, CASE WHEN is_tombstone THEN 1 ELSE 9 + strlen(value) END AS vl FROM entries)
SELECT run_id, key, CAST(sum(vl) OVER (PARTITION BY run_id) + coalesce(sum(kl) OVER w, 0) AS BIGINT) AS key_pos, CAST(kl AS BIGINT) AS key_len,
       CAST(coalesce(sum(vl) OVER w, 0) AS BIGINT) AS val_pos, CAST(vl AS BIGINT) AS val_len
FROM e WINDOW w AS (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def lsm_layout(spark, sf_dir):
    return layout.pointers(ops.run_entries(events_log(spark, sf_dir)))


@_query(f"""WITH {ENTRIES}, e AS (SELECT run_id, strlen(key) + CASE WHEN is_tombstone THEN 1 ELSE 9 + strlen(value) END AS l FROM entries)
SELECT run_id, count(*) AS n_keys, CAST(sum(l) AS BIGINT) AS footer_pos, CAST(sum(l) + 32 * count(*) + 16 AS BIGINT) AS total_bytes FROM e GROUP BY run_id""")
def lsm_file_size(spark, sf_dir):
    return layout.file_sizes(ops.run_entries(events_log(spark, sf_dir)))


FLUSHED = f"""{MEMTABLE.replace(LOG, ENTRIES)},
flushed AS (SELECT run_id, max_by(size, seq) AS flushed_bytes FROM sized GROUP BY run_id)"""


@_query(f"""{FLUSHED}
SELECT run_id, flushed_bytes, count(*) AS n_keys, count(*) FILTER (is_tombstone) AS n_tombstones
FROM flushed JOIN entries USING (run_id) GROUP BY run_id, flushed_bytes""")
def lsm_flush_metrics(spark, sf_dir):
    return metrics.flush_metrics(events_log(spark, sf_dir))


@_query(f"{FLUSHED} SELECT CAST(sum(flushed_bytes) AS BIGINT) AS flushed_bytes, count(*) AS flushed_to_disk FROM flushed")
def lsm_flush_totals(spark, sf_dir):
    return metrics.flush_totals(events_log(spark, sf_dir))


@_query(f"""WITH {COMMANDS}, g AS (SELECT *, (SELECT count(*) FROM commands f WHERE f.cmd = 'FLUSHALL' AND f.seq < c.seq) AS run FROM commands c),
w AS (SELECT *, last_value(CASE WHEN cmd IN ('SET', 'DEL') THEN cmd END IGNORE NULLS) OVER (PARTITION BY run, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM g)
SELECT count(*) FILTER (s = 'SET') AS fetched_from_memory, count(*) FILTER (s IS DISTINCT FROM 'SET') AS fetched_from_disk FROM w WHERE cmd = 'GET'""")
def lsm_read_metrics(spark, sf_dir):
    return metrics.read_metrics(events_commands(spark, sf_dir))


@_query(f"WITH {SERIES} SELECT user_id, event_id, delta FROM deltas")
def ts_delta(spark, sf_dir):
    return codec.deltas(events_series(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id", "delta")


@_query(f"WITH {SERIES} SELECT user_id, event_id, dod FROM dods")
def ts_dod(spark, sf_dir):
    return codec.deltas(events_series(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id", "dod")


@_query(f"WITH {SERIES} SELECT user_id, event_id, delta, value FROM deltas")
def ts_integrate(spark, sf_dir):
    dods = codec.deltas(events_series(spark, sf_dir), ["user_id"], "event_id").select("user_id", "event_id", "dod")
    return codec.integrate(dods, ["user_id"], "event_id").select("user_id", "event_id", "delta", "value")


@_query(f"""WITH {SERIES} SELECT event_id, ['NoChange', 'Bits7', 'Bits9', 'Bits16', 'Bits32', 'Bits64'][b + 1] AS bucket,
       ['0', '10', '110', '1110', '11110', '111110'][b + 1] AS prefix, [0, 7, 9, 16, 32, 64][b + 1] AS width, [1, 9, 12, 20, 37, 70][b + 1] AS bits,
       CASE WHEN dod < 0 AND b < 5 THEN abs(dod) + (1::BIGINT << ([0, 7, 9, 16, 32, 64][b + 1] - 1)) WHEN dod < 0 THEN abs(dod) - 9223372036854775808 ELSE dod END::BIGINT AS payload
FROM coded""")
def ts_codes(spark, sf_dir):
    dods = codec.deltas(events_series(spark, sf_dir), ["user_id"], "event_id")
    return dods.select("event_id", codec.bucket().alias("bucket"), codec.prefix().alias("prefix"), codec.payload_width().alias("width"), codec.code_bits().alias("bits"), codec.payload().alias("payload"))


@_query(f"WITH {SERIES} SELECT ['NoChange', 'Bits7', 'Bits9', 'Bits16', 'Bits32', 'Bits64'][b + 1] AS bucket, count(*) AS n FROM coded GROUP BY ALL")
def ts_bucket_hist(spark, sf_dir):
    dods = codec.deltas(events_series(spark, sf_dir), ["user_id"], "event_id")
    return dods.groupBy(codec.bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


SIZES = f"""WITH {SERIES}, s AS (SELECT user_id, count(*) AS n, CAST(sum([1, 9, 12, 20, 37, 70][b + 1]) AS BIGINT) AS n_bits FROM coded GROUP BY user_id)"""


@_query(f"{SIZES} SELECT user_id, n, n_bits, CAST(8 * greatest(1, ceil(n_bits / 64)) AS BIGINT) AS n_bytes, 64.0::DOUBLE * n / n_bits AS ratio FROM s")
def ts_encoded_size(spark, sf_dir):
    return codec.encoded_sizes(events_series(spark, sf_dir), ["user_id"], "event_id")


@_query(f"{SIZES} SELECT user_id, n, n_bits, CAST(8 * greatest(1, ceil(n_bits / 64)) AS BIGINT) AS n_bytes FROM s")
def ts_encode(spark, sf_dir):
    encoded = codec.encode_series(events_series(spark, sf_dir), ["user_id"], "event_id")
    return encoded.select("user_id", "n", "n_bits", F.octet_length("payload").cast("long").alias("n_bytes"))


@_query("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, epoch_us(ts) AS value FROM events")
def ts_roundtrip(spark, sf_dir):
    return codec.decode_series(codec.encode_series(events_series(spark, sf_dir), ["user_id"], "event_id"), ["user_id"])


@_query(f"""WITH {SERIES}, c AS (
  SELECT user_id, event_id, ['0', '10', '110', '1110', '11110', '111110'][b + 1] AS prefix, [0, 7, 9, 16, 32, 64][b + 1] AS width FROM coded),
n AS (SELECT event_id, prefix || CASE WHEN width = 0 THEN '' ELSE lpad(bin(event_id), 64, '0')[65 - width:] END AS bits FROM c)
SELECT event_id, bits, rpad(bits, CAST(64 * greatest(1, ceil(length(bits) / 64)) AS INTEGER), '0') AS padded FROM n""")
def ts_bit_strings(spark, sf_dir):
    """Every width: the widest code is padded to two words."""
    dods = codec.deltas(events_series(spark, sf_dir), ["user_id"], "event_id")
    text = F.concat(codec.prefix(), bits.bit_string(F.col("event_id"), codec.payload_width()))
    return dods.select("event_id", text.alias("bits"), bits.padded(text).alias("padded"))


# A series per user that needs codes of all six widths.
SCALES = (0, 1, 40, 3_000, 1_000_000, 10_000_000_000)
WIDE = SERIES.replace("epoch_us(ts) AS value", f"(event_id // 3) * {list(SCALES)}[user_id % 6 + 1] AS value")
PAYLOAD = "CASE WHEN dod < 0 AND b < 5 THEN abs(dod) + (1::BIGINT << ([0, 7, 9, 16, 32, 64][b + 1] - 1)) WHEN dod < 0 THEN abs(dod) - 9223372036854775808 ELSE dod END::BIGINT"
STREAM = f"""WITH {WIDE}, bits AS (
  SELECT user_id, event_id, ['0', '10', '110', '1110', '11110', '111110'][b + 1] || CASE WHEN b = 0 THEN '' ELSE lpad(bin({PAYLOAD}), 64, '0')[65 - [0, 7, 9, 16, 32, 64][b + 1]:] END AS code
  FROM coded),
streams AS (SELECT user_id, count(*) AS n, string_agg(code, '' ORDER BY event_id) AS s FROM bits GROUP BY user_id),
padded AS (SELECT user_id, n, CAST(length(s) AS BIGINT) AS n_bits, rpad(s, CAST(64 * greatest(1, ceil(length(s) / 64)) AS INTEGER), '0') AS p FROM streams)
SELECT user_id, n, n_bits, array_to_string(list_transform(range(0, length(p) // 4), lambda x:
       '0123456789abcdef'[CAST(1 + 8 * CAST(p[4 * x + 1] AS BIGINT) + 4 * CAST(p[4 * x + 2] AS BIGINT) + 2 * CAST(p[4 * x + 3] AS BIGINT) + CAST(p[4 * x + 4] AS BIGINT) AS BIGINT)]), '') AS stream
FROM padded"""


def wide_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = F.get(F.array(*(F.lit(x).cast("long") for x in SCALES)), F.col("user_id") % 6)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", (F.expr("event_id div 3") * scale).alias("value"))


@_query(f"WITH {WIDE} SELECT ['NoChange', 'Bits7', 'Bits9', 'Bits16', 'Bits32', 'Bits64'][b + 1] AS bucket, count(*) AS n FROM coded GROUP BY ALL")
def ts_bucket_hist_wide(spark, sf_dir):
    return codec.deltas(wide_series(spark, sf_dir), ["user_id"], "event_id").groupBy(codec.bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@_query(f"""WITH {WIDE} SELECT event_id, ['0', '10', '110', '1110', '11110', '111110'][b + 1] AS prefix, [0, 7, 9, 16, 32, 64][b + 1] AS width, {PAYLOAD} AS payload FROM coded""")
def ts_codes_wide(spark, sf_dir):
    dods = codec.deltas(wide_series(spark, sf_dir), ["user_id"], "event_id")
    return dods.select("event_id", codec.prefix().alias("prefix"), codec.payload_width().alias("width"), codec.payload().alias("payload"))


@_query(STREAM)
def ts_stream_bytes(spark, sf_dir):
    """The encoded bytes, in hexadecimal digits."""
    encoded = codec.encode_series(wide_series(spark, sf_dir), ["user_id"], "event_id")
    return encoded.select("user_id", "n", "n_bits", F.lower(F.hex("payload")).alias("stream"))


@_query(f"WITH {WIDE} SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value FROM series")
def ts_block_roundtrip(spark, sf_dir):
    """Series in blocks of 16 values, each encoded and decoded for itself."""
    encoded = codec.encode_blocks(wide_series(spark, sf_dir), ["user_id"], "event_id", size=16)
    return codec.decode_blocks(encoded, ["user_id"], size=16)


# A log of four generations whatever its length, for a store of runs.
QUARTERS = LOG.replace(f"event_id // {GENERATION} AS run_id", "event_id * 4 // (SELECT count(*) FROM events) + 1 AS run_id")
STORED = ENTRIES.replace(LOG, QUARTERS) + """,
described AS (
  SELECT run_id, count(*) AS n_keys, count(*) FILTER (is_tombstone) AS n_tombstones, CAST(sum(strlen(key) + CASE WHEN is_tombstone THEN 1 ELSE 9 + strlen(value) END + 32) + 16 AS BIGINT) AS total_bytes,
         max(seq) AS created_seq, min(seq) AS min_seq, min(key) AS first_key, max(key) AS last_key
  FROM entries GROUP BY run_id)"""
PAIRS = """merged AS (
  SELECT (run_id - 1) // 2 + 5 AS run_id, key, value, is_tombstone, seq FROM entries
  QUALIFY row_number() OVER (PARTITION BY (run_id - 1) // 2, key ORDER BY seq DESC) = 1)"""


def _store(spark: SparkSession, sf_dir: str) -> RunStore:
    """A new store with the four generations flushed."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    log = change_log(events, F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type"), F.col("event_type") == "error")
    store, n = RunStore(spark, scratch(spark)), events.count()
    for quarter in range(4):
        store.flush(log.where(F.expr(f"seq * 4 div {n}") == quarter))
    return store


def _described(manifest: DataFrame) -> DataFrame:
    keys = (F.col("min_key").cast("string").alias("first_key"), F.col("max_key").cast("string").alias("last_key"))
    return manifest.select("run_id", "n_keys", "n_tombstones", "total_bytes", "created_seq", "min_seq", *keys, "state")


@_query(f"WITH {STORED} SELECT *, 'live' AS state FROM described")
def lsm_store_flush(spark, sf_dir):
    """The manifest after four flushes; registering a run again changes nothing."""
    store = _store(spark, sf_dir)
    store.register(2)
    return _described(store.manifest())


@_query(f"""WITH {STORED}, {PAIRS}
SELECT *, 'retired' AS state FROM described UNION ALL
SELECT run_id, count(*), count(*) FILTER (is_tombstone), CAST(sum(strlen(key) + CASE WHEN is_tombstone THEN 1 ELSE 9 + strlen(value) END + 32) + 16 AS BIGINT), max(seq), min(seq), min(key), max(key), 'live'
FROM merged GROUP BY run_id""")
def lsm_store_compact(spark, sf_dir):
    """The manifest after a merge of pairs: old runs retired, new ones live."""
    store = _store(spark, sf_dir)
    store.compact()
    return _described(store.manifest())


@_query(f"WITH {STORED}, {PAIRS} SELECT * FROM merged WHERE NOT (is_tombstone AND run_id = 5)")
def lsm_store_drop_tombstones(spark, sf_dir):
    """Live entries after a merge that drops tombstones: only the oldest pair may."""
    store = _store(spark, sf_dir)
    store.compact(drop_tombstones=True)
    store.vacuum()
    return store.entries().select("run_id", "key", "value", "is_tombstone", "seq")


@_query(f"WITH {STORED} SELECT key, value FROM entries WHERE run_id <> 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1 AND NOT is_tombstone")
def lsm_store_retire(spark, sf_dir):
    """Reads after one run was taken out."""
    store = _store(spark, sf_dir)
    store.retire([2])
    return ops.latest(store.entries()).select("key", "value")


@_query(f"WITH {STORED} SELECT key, value FROM entries WHERE run_id = 4 AND NOT is_tombstone")
def lsm_open_get(spark, sf_dir):
    """Reads of the open generation alone."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    n = events.count()
    run = F.expr(f"CASE WHEN event_id * 4 div {n} < 3 THEN event_id * 4 div {n} END")
    log = change_log(events, F.col("event_id"), F.col("user_id").cast("string"), F.col("event_type"), F.col("event_type") == "error", run)
    return ops.latest(log.where("run_id IS NULL"))


@_query(f"WITH {STORED} SELECT run_id, key, value, is_tombstone, total_bytes AS file_bytes FROM entries JOIN described USING (run_id)")
def lsm_raw_roundtrip(spark, sf_dir):
    """Each run as one raw file, made and read again."""
    store = _store(spark, sf_dir)
    entries = store.entries().select("run_id", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "is_tombstone")
    read = raw_sstable.decode_files(raw_sstable.encode_files(entries))
    return read.select("run_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "is_tombstone", "file_bytes")


@_query(f"""WITH {STORED}, h AS (SELECT run_id, key, CASE WHEN is_tombstone THEN '00' ELSE '01' || lpad(lower(hex(strlen(value))), 2, '0') || repeat('00', 7) || lower(hex(value)) END AS encoded FROM entries)
SELECT *, CAST(length(encoded) // 2 AS BIGINT) AS n_bytes FROM h""")
def lsm_value_bytes(spark, sf_dir):
    entries = _store(spark, sf_dir).entries()
    encoded = entries.select("run_id", "key", F.lower(F.hex(layout.value_bytes("value", "is_tombstone"))).alias("encoded"))
    return encoded.withColumn("n_bytes", F.expr("CAST(length(encoded) div 2 AS BIGINT)"))


@_query(f"WITH {STORED} SELECT run_id, key, value, is_tombstone FROM entries")
def lsm_read_by_pointer(spark, sf_dir):
    """Values read from the raw files by their pointers."""
    entries = _store(spark, sf_dir).entries().select("run_id", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), "is_tombstone")
    found = raw_sstable.read_pointers(raw_sstable.encode_files(entries), layout.pointers(entries))
    return found.select("run_id", F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "is_tombstone")


@_query(f"WITH {ENTRIES} SELECT key, run_id AS table_idx, row_number() OVER (ORDER BY key DESC, run_id) - 1 AS nth FROM entries")
def lsm_kway_merge_descending(spark, sf_dir):
    merged = merge.kway_merge(ops.run_entries(events_log(spark, sf_dir)).withColumn("table_idx", F.col("run_id")), descending=True)
    return number_within(merged.select("key", "table_idx"), [], [F.desc("key"), F.asc("table_idx")], "nth")


@_query(f"""WITH {COMMANDS}, c AS (SELECT seq, CASE WHEN seq % 103 = 50 THEN 'CONFIG' ELSE cmd END AS cmd FROM commands)
SELECT cmd, CASE WHEN cmd IN ('set', 'CONFIG') THEN 'error' ELSE 'known' END AS kind, count(*) AS n FROM c GROUP BY ALL""")
def lsm_command_config(spark, sf_dir):
    """CONFIG is an unknown command like any other."""
    rows = events_commands(spark, sf_dir).withColumn("cmd", F.when(F.col("seq") % 103 == 50, "CONFIG").otherwise(F.col("cmd")))
    rows = rows.withColumn("args", F.when(F.col("cmd") == "CONFIG", F.array(F.lit("GET"), F.lit("save"))).otherwise(F.col("args")))
    kind = plans.replay(rows).select("seq", F.when(F.col("kind") == "error", "error").otherwise("known").alias("kind"))
    return rows.join(kind, "seq").groupBy("cmd", "kind").agg(F.count(F.lit(1)).alias("n"))


THRESHOLD = 2_000


@_query(f"""WITH RECURSIVE {LOG}, cuts AS (
  SELECT 0 AS run, CAST(-1 AS BIGINT) AS after, (SELECT max(seq) FROM log) AS final
  UNION ALL
  SELECT c.run + 1, (
    SELECT min(seq) FROM (
      SELECT seq, sum(change) OVER (ORDER BY seq) AS size FROM (
        SELECT seq, CASE WHEN NOT is_tombstone THEN CASE WHEN coalesce(sum(CASE WHEN NOT is_tombstone THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
                    THEN strlen(key) + strlen(value) ELSE 0 END
               ELSE 1 - coalesce(strlen(lag(value) OVER (PARTITION BY key ORDER BY seq)), 0) END AS change
        FROM log WHERE seq > c.after)) WHERE size >= {THRESHOLD}), c.final
  FROM cuts c WHERE c.after IS NOT NULL AND c.after < c.final)
SELECT l.seq, (SELECT min(run) FROM cuts c WHERE c.run > 0 AND c.after >= l.seq) - 1 AS run_id FROM log l""")
def lsm_threshold_flush(spark, sf_dir):
    """Runs cut where a generation's accounted size reaches 2,000 bytes."""
    return ops.cut_runs(events_log(spark, sf_dir), THRESHOLD).select("seq", "run_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
