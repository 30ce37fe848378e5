"""Delta-of-delta coding of time series.

Each value is coded as the change of its difference to the value before it (both
begin at 0), in the smallest of six buckets: a prefix and a sign-magnitude
payload whose top bit is the sign. A negative number needs one bit more than its
magnitude has, and a bucket must be wider than what it holds.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from stratalog.functions.bits import WORD, BitReader, BitWriter
from stratalog.tables import number_within

# Fixed values of the format: bucket, prefix bits, payload bits.
BUCKETS = (("NoChange", "0", 0), ("Bits7", "10", 7), ("Bits9", "110", 9), ("Bits16", "1110", 16), ("Bits32", "11110", 32), ("Bits64", "111110", 64))
LONGEST = (1 << 63) - 1
# The same, as arrays by bucket; and the bucket by a code's first six bits, -1 where none begins so.
_PREFIX = np.array([int(code, 2) for _, code, _ in BUCKETS], np.uint64)
_PREFIX_BITS = np.array([len(code) for _, code, _ in BUCKETS], np.int64)
_WIDTH = np.array([width for _, _, width in BUCKETS], np.int64)
_BY_HEAD = np.array([next((i for i, (_, code, _) in enumerate(BUCKETS) if f"{head:06b}".startswith(code)), -1) for head in range(64)])


def _series(by: list[str], order: str):
    return Window.partitionBy(*by).orderBy(order)


def deltas(df: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """Add ``delta`` and ``dod``; an overflow of bigint is an error."""
    w = _series(by, order)
    delta = F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0))
    with_delta = df.withColumn("delta", delta)
    return with_delta.withColumn("dod", F.col("delta") - F.coalesce(F.lag("delta").over(w), F.lit(0)))


def integrate(df: DataFrame, by: list[str], order: str, dod: str = "dod") -> DataFrame:
    """Add ``delta`` and ``value`` from second differences."""
    w = _series(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("delta", F.sum(dod).over(w)).withColumn("value", F.sum("delta").over(w))


def _choose(dod: Column, pick) -> Column:
    out = None
    for i, (_, _, width) in enumerate(BUCKETS):
        if width == 0:
            fits = dod == 0
        elif width == 64:
            fits = F.lit(True)
        else:
            fits = (dod < F.lit(1 << (width - 1))) & (dod > F.lit(-(1 << (width - 2))))
        out = F.when(fits, pick(i)) if out is None else out.when(fits, pick(i))
    return out


def bucket(dod: str | Column = "dod") -> Column:
    dod = F.col(dod) if isinstance(dod, str) else dod
    return _choose(dod, lambda i: F.lit(BUCKETS[i][0]))


def prefix(dod: str | Column = "dod") -> Column:
    dod = F.col(dod) if isinstance(dod, str) else dod
    return _choose(dod, lambda i: F.lit(BUCKETS[i][1]))


def payload_width(dod: str | Column = "dod") -> Column:
    dod = F.col(dod) if isinstance(dod, str) else dod
    return _choose(dod, lambda i: F.lit(BUCKETS[i][2]))


def code_bits(dod: str | Column = "dod") -> Column:
    """Bits of a coded value: prefix and payload."""
    dod = F.col(dod) if isinstance(dod, str) else dod
    return _choose(dod, lambda i: F.lit(len(BUCKETS[i][1]) + BUCKETS[i][2]))


def payload(dod: str | Column = "dod") -> Column:
    """The payload as a bigint (of 64 bits: as its two's complement)."""
    dod = F.col(dod) if isinstance(dod, str) else dod
    top = lambda i: F.lit(1 << BUCKETS[i][2] - 1 if 0 < BUCKETS[i][2] < 64 else -LONGEST - 1).cast("long")
    sign = F.when(dod < 0, _choose(dod, top)).otherwise(F.lit(0).cast("long"))
    return F.abs(dod).bitwiseOR(sign)


def encoded_sizes(df: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """(by, n, n_bits, n_bytes, ratio) of every series, without encoding it."""
    sizes = deltas(df, by, order, value).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(code_bits()).cast("long").alias("n_bits"))
    return sizes.withColumn("n_bytes", (8 * F.greatest(F.lit(1), F.ceil(F.col("n_bits") / 64))).cast("long")).withColumn("ratio", 64.0 * F.col("n") / F.col("n_bits"))


def write_value(bits: BitWriter, dod: int) -> None:
    need = abs(dod).bit_length() + (dod < 0)
    if need > 64 or abs(dod) > LONGEST:
        raise OverflowError(f"{dod} can't be coded in 64 bits")
    _, code, width = next(b for b in BUCKETS if dod == 0 or b[2] == 64 or need < b[2])
    bits.write(int(code, 2), len(code))
    if width:
        bits.write(abs(dod) | ((dod < 0) << (width - 1)), width)


def read_value(bits: BitReader) -> int:
    ones = 0
    while bits.read_bit():
        ones += 1
        if ones >= len(BUCKETS):
            raise ValueError("no code begins with so many ones")
    width = BUCKETS[ones][2]
    if not width:
        return 0
    raw = bits.read(width)
    size = raw & ((1 << (width - 1)) - 1)
    return -size if raw >> (width - 1) else size


def encode(values: Iterable[int], last: int = 0, delta: int = 0) -> tuple[bytes, int, int]:
    """(stream, bits used, number of values) after a value and a difference. Keep
    the number: zeros that pad the stream read as further values."""
    bits, n = BitWriter(), 0
    for value in values:
        value = int(value)
        if not -LONGEST - 1 <= value - last <= LONGEST:
            raise OverflowError("a difference exceeds 64 bits")
        step = value - last
        write_value(bits, step - delta)
        last, delta, n = value, step, n + 1
    return bits.finish(), bits.bits_written, n


def decode(stream: bytes, n: int, last: int = 0, delta: int = 0) -> Iterator[int]:
    return _read_values(BitReader(stream), n, last, delta)


def _read_values(bits: BitReader, n: int, value: int, delta: int) -> Iterator[int]:
    for _ in range(n):
        delta += read_value(bits)
        value += delta
        yield value


def _add(a: np.ndarray, b: np.ndarray, message: str) -> np.ndarray:
    total = a + b
    if (((a ^ total) & (b ^ total)) < 0).any():
        raise OverflowError(message)
    return total


def _minus(a: np.ndarray, b: np.ndarray, message: str) -> np.ndarray:
    rest = a - b
    if (((a ^ b) & (a ^ rest)) < 0).any():
        raise OverflowError(message)
    return rest


def _put(words: np.ndarray, at: np.ndarray, code: np.ndarray, width: np.ndarray) -> None:
    """Set the codes' bits, none of them empty, at rising places ``at``."""
    word, shift = at >> 6, WORD - (at & 63) - width
    over = shift < 0  # goes on in the next word
    head = np.where(over, code >> np.maximum(-shift, 0).astype(np.uint64), code << np.maximum(shift, 0).astype(np.uint64))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] |= np.bitwise_or.reduceat(head, first)
    words[word[over] + 1] |= code[over] << (WORD + shift[over]).astype(np.uint64)


def encode_many(values: np.ndarray, begins: np.ndarray, last: np.ndarray, delta: np.ndarray, held: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each stream, its bits, the values' differences) of the
    streams whose values begin at ``begins`` (from 0), each after its value and
    difference, as ``encode`` makes them one by one. The first leaves ``held`` bits
    free before its own."""
    before = np.concatenate([[0], values[:-1]])
    before[begins] = last
    steps = _minus(values, before, "a difference exceeds 64 bits")
    before = np.concatenate([[0], steps[:-1]])
    before[begins] = delta
    dod = _minus(steps, before, "a second difference can't be coded in 64 bits")
    if (dod == -LONGEST - 1).any():
        raise OverflowError(f"{-LONGEST - 1} can't be coded in 64 bits")
    size, is_less = np.abs(dod), dod < 0
    # The least size that a bucket doesn't hold: half as much below zero.
    kind = np.searchsorted(1 << (_WIDTH[1:5] - 1), np.where(is_less, np.minimum(size, 1 << 61) * 2, size), side="right") + 1
    kind[dod == 0] = 0
    width, ahead = _WIDTH[kind], _PREFIX_BITS[kind]
    ends = np.cumsum(width + ahead)
    starts = ends - width - ahead
    n_bits = np.diff(starts[begins], append=ends[-1])
    n_words = -(-(n_bits + np.where(np.arange(len(begins)) == 0, held, 0)) // WORD)  # a value has a bit at least
    first_word = np.cumsum(n_words) - n_words
    moved = WORD * first_word - starts[begins]
    moved[0] += held
    at = starts + np.repeat(moved, np.diff(begins, append=len(values)))
    words = np.zeros(int(n_words.sum()) + 1, np.uint64)
    _put(words, at, _PREFIX[kind], ahead)
    some = np.flatnonzero(width)
    if len(some):
        payload = size.astype(np.uint64) | (is_less.astype(np.uint64) << np.maximum(width - 1, 0).astype(np.uint64))
        _put(words, (at + ahead)[some], payload[some], width[some])
    return words[:-1], first_word, n_bits, steps


def decode_many(streams: list[bytes], n: np.ndarray, last: np.ndarray, delta: np.ndarray) -> np.ndarray:
    """The values of all streams, one stream after another, as ``decode`` reads them
    one by one: a step reads the next value of every stream that has one."""
    if any(len(s) < WORD // 8 for s in streams):
        raise ValueError("a stream has a word at least")
    offset = np.cumsum(n) - n
    out = np.empty(int(n.sum()), np.int64)
    # The longest first, so that those with a next value are always in front.
    order = np.argsort(-n, kind="stable")
    n_words = np.array([-(-len(s) // 8) for s in streams], np.int64)
    start = WORD * (np.cumsum(n_words) - n_words)
    words = np.frombuffer(b"".join(s.ljust(8 * int(w), b"\0") for s, w in zip(streams, n_words, strict=True)) + bytes(16), ">u8").astype(np.uint64)
    end = (start + 8 * np.array([len(s) for s in streams], np.int64))[order]
    at, value, step, left, into = start[order], last[order], delta[order], n[order], offset[order]

    def window(at: np.ndarray) -> np.ndarray:
        """The next 64 bits."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        # In two shifts, as none may be by 64.
        return (words[word] << bit) | (words[word + 1] >> np.uint64(1) >> (np.uint64(63) - bit))

    k, active = 0, int((left > 0).sum())
    while active >= FEW:
        at, value, step, end, into, left = (x[:active] for x in (at, value, step, end, into, left))
        kind = _BY_HEAD[window(at) >> np.uint64(58)]
        width = _WIDTH[kind]
        at = at + _PREFIX_BITS[kind]
        if (kind < 0).any():
            raise ValueError("no code begins with so many ones")
        if (at + width > end).any():
            raise EOFError("past the end of the stream")
        top = np.maximum(width, 1).astype(np.uint64)
        raw = np.where(width > 0, window(np.minimum(at, end)) >> (np.uint64(WORD) - top), np.uint64(0))
        at = at + width
        sign = raw >> (top - np.uint64(1))
        size = (raw & ~(sign << (top - np.uint64(1)))).astype(np.int64)
        step = _add(step, np.where(sign > 0, -size, size), "a difference exceeds 64 bits")
        value = _add(value, step, "a value exceeds 64 bits")
        out[into + k] = value
        k += 1
        active = int(np.searchsorted(-left, -k, side="left"))
    for i in range(active):
        stream = order[i]
        bits = BitReader(streams[stream])
        bits.position = int(at[i] - start[stream])
        rest = _read_values(bits, int(left[i]) - k, int(value[i]), int(step[i]))
        out[into[i] + k : into[i] + left[i]] = np.fromiter(rest, np.int64, int(left[i]) - k)
    return out


def _encode_rows(rows: DataFrame, keys: list[str], is_after: bool = False) -> DataFrame:
    """(keys, n, n_bits, payload) of rows (keys, __first, __value) that are sorted by
    series, with __first where one begins. Series are coded by batches of rows, not
    one by one, and a long one is held as its stream only. If ``is_after``, the keys
    ``last`` and ``delta`` are what comes before the series."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def coded(key: pa.RecordBatch, n: list, n_bits: list, streams: list) -> pa.RecordBatch:
        columns = [*key.columns, pa.array(n, pa.int64()), pa.array(n_bits, pa.int64()), pa.array(streams, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", "n_bits", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The series that may go on: its key, whole words, the word begun, bits, number, last value and difference.
        key, whole, word, used, n, last, delta = None, bytearray(), 0, 0, 0, 0, 0

        for batch in batches:
            if not batch.num_rows:
                continue
            if batch.column("__value").null_count:
                raise ValueError("a value is null")
            values = batch.column("__value").to_numpy()
            news = np.flatnonzero(batch.column("__first").to_numpy(zero_copy_only=False))
            goes_on = not len(news) or news[0] > 0
            begins = np.concatenate([[0], news]) if goes_on else news
            lasts, deltas = (batch.column(k).to_numpy()[begins] if is_after else np.zeros(len(begins), np.int64) for k in ("last", "delta"))
            if goes_on:
                lasts, deltas = np.concatenate([[last], lasts[1:]]), np.concatenate([[delta], deltas[1:]])
            elif key is not None:
                yield coded(key, [n], [used], [bytes(whole) + word.to_bytes(8, "big") * (used % WORD > 0)])
            held = used % WORD if goes_on else 0
            words, first_word, n_bits, steps = encode_many(values, begins, lasts, deltas, held)
            counts = np.diff(begins, append=len(values))
            if goes_on:
                words[0] |= np.uint64(word if held else 0)
                n_bits[0] += used
                counts[0] += n
            raw = words.astype(">u8").tobytes()
            edges = [*(8 * first_word).tolist(), len(raw)]
            streams = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            own = batch.select(keys)
            heads = own.take(pa.array(begins))
            if goes_on and len(begins) > 1:
                yield coded(key, [int(counts[0])], [int(n_bits[0])], [bytes(whole) + streams[0]])
            done = slice(1 if goes_on else 0, len(begins) - 1)
            if done.stop > done.start:
                yield coded(heads.slice(done.start, done.stop - done.start), counts[done].tolist(), n_bits[done].tolist(), streams[done])
            if not goes_on or len(begins) > 1:
                key, whole = heads.slice(len(begins) - 1), bytearray()
            used, n = int(n_bits[-1]), int(counts[-1])
            last, delta = int(values[-1]), int(steps[-1])
            begun = 8 if used % WORD else 0
            whole += streams[-1][: len(streams[-1]) - begun]
            word = int.from_bytes(streams[-1][len(streams[-1]) - begun :], "big")
        if key is not None:
            yield coded(key, [n], [used], [bytes(whole) + word.to_bytes(8, "big") * (used % WORD > 0)])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n long", "n_bits long", "payload binary"])
    return rows.select(*keys, "__first", "__value").mapInArrow(run, schema)


def encode_series(df: DataFrame, by: list[str], order: str, value: str = "value") -> DataFrame:
    """(by, n, n_bits, payload) of every series. A series is encoded in one task,
    as one stream is sequential; ``encode_blocks`` splits long ones."""
    w = Window.partitionBy(*by).orderBy(F.col("__order").asc_nulls_last())
    named = df.select(*by, F.col(order).alias("__order"), F.col(value).cast("long").alias("__value"))
    return _encode_rows(named.withColumn("__first", F.row_number().over(w) == 1), by)


#: Values of a block.
BLOCK = 65_536


def encode_blocks(df: DataFrame, by: list[str], order: str, value: str = "value", size: int = BLOCK) -> DataFrame:
    """(by, block, last, delta, n, n_bits, payload): every series in blocks of
    ``size`` values, each with the value and difference before it, so that a series
    with any share of the rows spreads over many tasks and blocks are decoded each
    for itself. The blocks' bits, one after another, are the series' stream."""
    named = df.select(*by, F.col(order).alias("__order"), F.col(value).cast("long").alias("__value"))
    numbered = number_within(named, by, ["__order"], "__place").drop("__order")
    # A block's last two values go to the next block too, where they only set its
    # start.
    here = F.floor(F.col("__place") / size).cast("long")
    ends = F.col("__place") % size >= size - 2
    dealt = numbered.withColumn("block", F.explode(F.when(ends, F.array(here, here + 1)).otherwise(F.array(here))))
    w = _series([*by, "block"], "__place")
    last, second = (F.coalesce(F.lag("__value", k).over(w), F.lit(0)) for k in (1, 2))
    started = dealt.withColumns({"last": last, "delta": last - second})
    own = started.where(F.col("__place") >= F.col("block") * size)
    return _encode_rows(own.withColumn("__first", F.col("__place") == F.col("block") * size), [*by, "block", "last", "delta"], is_after=True)


#: Values decoded at once, and streams from which reading them side by side pays.
AT_ONCE, FEW = 1 << 18, 16


def _decode_rows(encoded: DataFrame, by: list[str], size: int) -> DataFrame:
    """(by, i, value) of rows (by, n, payload), with block, last and delta if ``size``
    isn't 0, by portions of streams."""
    kinds = {f.name: f.dataType.simpleString() for f in encoded.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy()
            portion = (np.cumsum(n) - n) // AT_ONCE
            edges = [*np.flatnonzero(np.diff(portion, prepend=-1)).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                rows, counts = batch.slice(a, b - a), n[a:b]
                block, last, delta = (rows.column(k).to_numpy() if size else np.zeros(b - a, np.int64) for k in ("block", "last", "delta"))
                values = decode_many([s.as_py() for s in rows.column("payload")], counts, last, delta)
                which = np.repeat(np.arange(b - a), counts)
                places = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts) + (block * size)[which]
                for k in range(0, len(values), AT_ONCE):  # a long series goes back in pieces
                    keys = rows.select(by).take(pa.array(which[k : k + AT_ONCE]))
                    yield pa.RecordBatch.from_arrays([*keys.columns, pa.array(places[k : k + AT_ONCE]), pa.array(values[k : k + AT_ONCE])], names=[*by, "i", "value"])

    columns = ["block", "last", "delta"] if size else []
    return encoded.select(*by, *columns, "n", "payload").mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in by), "i long", "value long"]))


def decode_blocks(encoded: DataFrame, by: list[str], size: int = BLOCK) -> DataFrame:
    """(by, i, value) of every block."""
    return _decode_rows(encoded, by, size)


@udtf(returnType=T.StructType([T.StructField("i", T.LongType()), T.StructField("value", T.LongType())]))
class DecodeSeries:
    """decode_series(payload, n): rows (i, value)."""

    def eval(self, payload: bytes, n: int):
        yield from enumerate(decode(bytes(payload), n))


def decode_series(encoded: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, value) of every encoded series."""
    return _decode_rows(encoded, by, 0)
