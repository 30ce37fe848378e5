import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratalog.functions import bits, codec, layout

NOW = 1_700_000_000_000
COSTS = [(0, 1), (1, 9), (63, 9), (255, 12), (-255, 20), (-(2**31 - 1), 70), (2**63 - 1, 70), (-(2**63 - 1), 70)]
EDGES = [63, 64, 255, 256, 32767, 32768, 2**31 - 1, 2**31, -31, -32, -127, -128, -16383, -16384, -(2**30 - 1), -(2**30)]


@pytest.mark.parametrize("width", [3, 4, 7, 8, 12, 16, 18, 32, 63, 64])
def test_bits_round_trip(width):
    rng = random.Random(width)
    for values in ([i % 2 for i in range(128)], [(1 << width) - 1] * 128, [rng.getrandbits(width) for _ in range(128)]):
        w = bits.BitWriter()
        for v in values:
            w.write(v, width)
        assert w.bits_written == 128 * width
        r = bits.BitReader(w.finish())
        assert [r.read(width) for _ in values] == values


def test_bits_of_many_widths_single_bits_and_ends():
    rng, w = random.Random(1), bits.BitWriter()
    values = [(rng.getrandbits(64), rng.randrange(64)) for _ in range(128)]
    for v, n in values:
        w.write(v, n)
    w.on()
    w.off()
    r = bits.BitReader(w.finish())
    assert [r.read(n) for _, n in values] == [v & ((1 << n) - 1) for v, n in values]
    assert r.read_bit() is True and r.read_bit() is False
    assert bits.BitWriter().finish() == bytes(8)
    one = bits.BitWriter()
    for _ in range(64):
        one.off()
    assert len(one.finish()) == 8
    with pytest.raises(EOFError):
        bits.BitReader(bytes(8)).read(65)
    with pytest.raises(ValueError):
        bits.BitReader(b"")


@pytest.mark.parametrize("value,cost", COSTS)
def test_costs(value, cost):
    w = bits.BitWriter()
    codec.write_value(w, value)
    assert w.bits_written == cost
    assert codec.read_value(bits.BitReader(w.finish())) == value


@pytest.mark.parametrize("edge", EDGES)
def test_edges_round_trip(edge):
    for v in (edge - 1, edge, edge + 1):
        stream, _, n = codec.encode([v, v, 0])
        assert list(codec.decode(stream, n)) == [v, v, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**61), 2**61), max_size=40))
def test_any_series_round_trips(values):
    stream, used, n = codec.encode(values)
    assert list(codec.decode(stream, n)) == values and len(stream) == 8 * max(1, -(-used // 64))


def test_known_sizes_and_errors():
    assert codec.encode([NOW + 1000 * i for i in range(10)])[1] == 148
    assert codec.encode([i * NOW for i in range(1, 10)])[1] == 78
    assert codec.encode([5, 10, 15])[1] == 11
    # Padding reads as further values of the last step: the number must be kept.
    assert list(codec.decode(codec.encode([5, 10, 15])[0], 6)) == [5, 10, 15, 20, 25, 30]
    for bad in (-(2**63), 2**63):
        with pytest.raises(OverflowError):
            codec.encode([bad])
    with pytest.raises(OverflowError):
        codec.encode([2**62, -(2**62) - 1])
    with pytest.raises(ValueError):
        codec.read_value(bits.BitReader(b"\xff" * 8))


def test_columns_agree_with_the_codec(spark):
    rng = random.Random(4)
    values = [0, *EDGES, *(e + d for e in EDGES for d in (-1, 1)), *(rng.randrange(-(2**40), 2**40) for _ in range(50))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, dod long")
    for r in df.select("dod", codec.prefix().alias("p"), codec.payload_width().alias("w"), codec.code_bits().alias("b"), bits.bit_string(codec.payload(), codec.payload_width()).alias("s")).collect():
        w = bits.BitWriter()
        codec.write_value(w, r["dod"])
        want = format(int.from_bytes(w.finish(), "big"), f"0{8 * len(w.finish())}b")[: w.bits_written]
        assert r["b"] == w.bits_written and r["p"] + (r["s"] if r["w"] else "") == want


def test_series_frames(spark):
    rows = [(g, i, NOW + i * i * g) for g in range(4) for i in range(20)]
    df = spark.createDataFrame(rows, "g long, i long, value long")
    encoded = codec.encode_series(df, ["g"], "i")
    assert {(r["g"], r["n_bits"]) for r in encoded.collect()} == {(r["g"], r["n_bits"]) for r in codec.encoded_sizes(df, ["g"], "i").collect()}
    assert sorted(map(tuple, codec.decode_series(encoded, ["g"]).collect())) == sorted(rows)
    dods = codec.deltas(df, ["g"], "i").select("g", "i", "dod")
    assert sorted(map(tuple, codec.integrate(dods, ["g"], "i").select("g", "i", "value").collect())) == sorted(rows)
    spark.udtf.register("decode_series", codec.DecodeSeries)
    encoded.where("g = 2").createOrReplaceTempView("one_series")
    got = spark.sql("SELECT d.i, d.value FROM one_series, LATERAL decode_series(payload, n) d").collect()
    assert sorted(map(tuple, got)) == [(i, v) for g, i, v in rows if g == 2]


def test_value_and_pointer_codecs(spark):
    for v in (None, b"", b"x" * 300):
        assert layout.decode_value(layout.encode_value(v)) == v
    assert layout.decode_pointer(layout.encode_pointer(3, 2**40)) == (3, 2**40)
    with pytest.raises(ValueError):
        layout.decode_value(b"\x07")
    df = spark.createDataFrame([(b"ab", False, 1, 2), (None, True, 3, 4)], "v binary, gone boolean, p long, n long")
    got = df.select(layout.value_bytes("v", "gone").alias("v"), layout.pointer_bytes("p", "n").alias("p")).collect()
    assert [bytes(r["v"]) for r in got] == [layout.encode_value(b"ab"), b"\x00"] and bytes(got[1]["p"]) == layout.encode_pointer(3, 4)
    assert df.select(F.length(layout.value_bytes("v", "gone"))).count() == 2


def test_long_streams_are_linear():
    import time

    rng = random.Random(7)
    values = [rng.randrange(2**40) for _ in range(200_000)]
    began = time.perf_counter()
    stream, _, n = codec.encode(values)
    assert list(codec.decode(stream, n)) == values
    assert time.perf_counter() - began < 20  # seconds where a shifted big integer takes many minutes


def test_blocks_split_a_hot_series(spark):
    rows = [(0, i, i * i % 1000) for i in range(100)] + [(1, i, -i) for i in range(3)] + [(2, 7, 5)]
    df = spark.createDataFrame(rows, "g long, i long, value long")
    for size in (2, 10, 1000):
        encoded = codec.encode_blocks(df, ["g"], "i", size=size)
        places = {g: sorted(i for h, i, _ in rows if h == g) for g in range(3)}
        want = sorted((g, places[g].index(i), v) for g, i, v in rows)
        assert sorted(map(tuple, codec.decode_blocks(encoded, ["g"], size=size).collect())) == want
        assert encoded.where("g = 0").count() == -(-100 // size)
        bits_ = {r["g"]: r["n"] for r in encoded.groupBy("g").sum("n_bits").withColumnRenamed("sum(n_bits)", "n").collect()}
        assert bits_ == {r["g"]: r["n_bits"] for r in codec.encoded_sizes(df, ["g"], "i").collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**60), 2**60) | st.integers(-70, 70), min_size=1, max_size=9), min_size=1, max_size=40), st.integers(-(2**50), 2**50))
def test_many_streams_equal_single_ones(series, start):
    counts = np.array([len(s) for s in series])
    last, delta = np.full(len(series), start), np.full(len(series), -start)
    flat = np.array([v for s in series for v in s], np.int64)
    words, first, n_bits, _ = codec.encode_many(flat, np.cumsum(counts) - counts, last, delta)
    raw, edges = words.astype(">u8").tobytes(), [*(8 * first).tolist(), 8 * len(words)]
    want = [codec.encode(s, start, -start) for s in series]
    assert [(raw[a:b], n, len(s)) for a, b, n, s in zip(edges, edges[1:], n_bits.tolist(), series, strict=False)] == want
    assert codec.decode_many([w[0] for w in want], counts, last, delta).tolist() == flat.tolist()


def test_many_streams_errors():
    zero, one = np.array([0]), np.array([1])
    for bad in ([-(2**63)], [2**62, -(2**62) - 1], [2**62, -(2**62), 2**62]):
        with pytest.raises(OverflowError):
            codec.encode(bad)
        with pytest.raises(OverflowError):
            codec.encode_many(np.array(bad), zero, zero, zero)
    many = lambda stream, n: codec.decode_many([stream] * 20, np.full(20, n), np.zeros(20, int), np.zeros(20, int))
    assert many(codec.encode([5, 10, 15])[0], 6).tolist() == [5, 10, 15, 20, 25, 30] * 20
    for error, stream, n in ((ValueError, b"", 1), (ValueError, b"\xff" * 8, 1), (EOFError, bytes(8), 65), (OverflowError, codec.encode([2**62])[0], 3)):
        with pytest.raises(error):
            many(stream, n)
    with pytest.raises(EOFError):
        codec.decode_many([bytes(8)], 65 * one, zero, zero)
    assert codec.decode_many([], *[np.zeros(0, int)] * 3).tolist() == []


@pytest.mark.parametrize("batch", [1, 3, 64])
def test_series_that_go_on_over_batches(spark, batch):
    rng = random.Random(batch)
    series = {k: [rng.choice([0, rng.randrange(-(2 ** rng.randrange(1, 60)), 2**59)]) for _ in range(n)] for k, n in ((None, 9), ("", 1), ("a", 64), ("b", 5), ("c", 200))}
    df = spark.createDataFrame([(k, i, v) for k, values in series.items() for i, v in enumerate(values)], "k string, i long, value long").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        encoded = codec.encode_series(df, ["k"], "i")
        assert {r["k"]: (bytes(r["payload"]), r["n_bits"], r["n"]) for r in encoded.collect()} == {k: codec.encode(v) for k, v in series.items()}
        want = sorted((repr(k), i, v) for k, values in series.items() for i, v in enumerate(values))
        assert sorted((repr(k), i, v) for k, i, v in codec.decode_series(encoded, ["k"]).collect()) == want
        blocks = codec.encode_blocks(df, ["k"], "i", size=7)
        assert sorted((repr(k), i, v) for k, i, v in codec.decode_blocks(blocks, ["k"], size=7).collect()) == want
        for r in blocks.collect():
            own = series[r["k"]][7 * r["block"] : 7 * r["block"] + 7]
            assert (bytes(r["payload"]), r["n_bits"], r["n"]) == codec.encode(own, r["last"], r["delta"])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_null_values_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 1, None)], "g long, i long, value long")
    with pytest.raises(Exception, match="a value is null"):
        codec.encode_series(df, ["g"], "i").collect()


def test_many_small_blocks_cost_no_call_each(spark):
    import time

    df = spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.col("id").alias("i"), (F.col("id") * 3).alias("value"))
    encoded = codec.encode_blocks(df, ["g"], "i", size=2)
    began = time.perf_counter()
    got = codec.decode_blocks(encoded, ["g"], size=2).agg(F.count(F.lit(1)), F.sum("value"), F.sum("i")).first()
    assert tuple(got) == (60_000, 3 * sum(range(60_000)), 60_000)
    assert time.perf_counter() - began < 20  # 40,000 blocks: minutes with a call of Python for each
    for coded in (encoded, codec.encode_series(df, ["g"], "i")):
        assert "FlatMapGroups" not in coded._jdf.queryExecution().executedPlan().toString()
