"""Packing documents into training sequences by a configuration linear program.

1. ``pieces`` tokenizes each whole text once. A document of more than
   ``capacity`` ids (its end id counted) is cut into pieces of exactly that
   length; what doesn't fill one is its first piece.
2. Only the histogram of lengths, at most ``capacity`` numbers, reaches the
   driver. There ``solve`` approximates the configuration LP (how often to use
   each multiset of lengths that fits a sequence) by multiplicative weights: each
   length has a weight that falls as its demand is covered, and a knapsack
   dynamic program over the capacity prices the best configurations. The
   fractional counts are rounded greedily, the rest is packed best-fit
   decreasing, both on the histogram, so cost doesn't grow with the number of
   documents.
3. Pieces are numbered within their length (distributed, see number_within) and
   each looks its sequence and offset up in the plan, whose size is bounded by
   the number of configurations.

With ``order`` (a column that rises in the order the documents are to be read in),
sequences in ascending sequence_id keep to it as far as a plan of so few sequences
can: a configuration's sequences are dealt evenly over the whole, the pieces of each
length fill their places there in the documents' order, and sequences are numbered
by the mean place of their tokens in it.

Defined results: a null or empty text is its end id alone, one piece of length
1; rows that share a doc_id are packed each for itself; an empty table gives an
empty table. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.base import cut, drop_table, lean, number_within, partitions
from stratalog.llm.tokens import tokenizer

CAPACITY = 2048
#: Rounds of weights, and configurations priced in each: the plan's size.
ROUNDS, PER_ROUND = 260, 64
#: A configuration covers at most this share of the demand of each length.
STEP = 0.5
#: Rate of the multiplicative weights; how much dearer a whole sequence's length is.
RATE, BONUS = 0.2, 0.2

Plan = list[tuple[tuple[int, ...], int]]


def pieces(docs: DataFrame, capacity: int = CAPACITY, kind: str = "byte", end_id: int = 0, tokenizer_path: str | None = None, with_ids: bool = False, order: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, packed unsigned 32-bit; and
    __order)."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([] if order is None else [order.alias("__order")]))
    kept = [f"__order {f.dataType.simpleString()}" for f in read.schema.fields[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(kind, tokenizer_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows, of = [], []
                keys, texts = (c[a : a + 512].to_pylist() for c in batch.columns[:2])
                for k, (key, packed) in enumerate(zip(keys, tok.encode([t or "" for t in texts]))):
                    ids = np.append(np.frombuffer(packed, tok.code), end_id).astype("<u4")
                    first = len(ids) % capacity or capacity
                    for piece, end in enumerate(range(first, len(ids) + 1, capacity)):
                        start = max(0, end - capacity) if piece else 0
                        part = ids[start:end].tobytes()
                        rows.append((key, piece, start, end - start, zlib.crc32(part), part)[: len(names)])
                        of.append(a + k)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                places = [c.take(pa.array(of, pa.int64())) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*rows), types)), *places], names + ["__order"] * len(places))

    return read.mapInArrow(lean(run), ", ".join(["doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids, *kept]))


def best_fit(demand: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing on a histogram; equal sequences move together."""
    open_at: dict[int, Counter] = defaultdict(Counter)  # room -> contents -> how many
    rooms = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        left = int(demand[length])
        while left:
            fitting = np.flatnonzero(rooms[length:])
            if len(fitting):
                room = length + int(fitting[0])
                held, n = open_at[room].popitem()
                used = min(left, n)
                if n > used:
                    open_at[room][held] = n - used
                rooms[room] = bool(open_at[room])
                held, each = held + (length,), 1
            else:
                room, held = capacity, ()
                each = min(left, capacity // length)
                used = left // each
                held = (length,) * each
            left -= used * each
            room -= length * each
            open_at[room][held] += used
            rooms[room] = True
    return [(held, n) for group in open_at.values() for held, n in group.items()]


def _knapsack(price: np.ndarray, capacity: int) -> np.ndarray:
    """For each room, the length that its best contents (repeats allowed) end with."""
    lengths = np.flatnonzero(price > 0)
    worth = price[lengths]
    counts = np.searchsorted(lengths, np.arange(capacity + 1), side="right").tolist()
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := counts[room]:
            value = worth[:n] + best[room - lengths[:n]]
            k = int(value.argmax())
            if value[k] > best[room]:
                best[room], last[room] = value[k], lengths[k]
    return last


def _contents(room: int, last: np.ndarray) -> list[int]:
    held = []
    while room > 0:
        if last[room]:
            held.append(int(last[room]))
            room -= held[-1]
        else:
            room -= 1
    return held


def fractional(demand: np.ndarray, capacity: int) -> Counter:
    """Full configurations and how often to use each, a fractional solution.

    A length's price is its share of a sequence, a little more for a long one,
    times a weight that falls exponentially with the part of its demand covered
    so far. Each round prices by one dynamic program and takes the best
    configurations that hold the least covered lengths. Only full sequences are
    taken, so what stays uncovered is packed by best fit with nothing lost yet.
    """
    lengths = np.flatnonzero(demand)
    lengths = lengths[lengths < capacity]
    use: Counter = Counter()
    need, covered = demand.astype(float), np.zeros(capacity + 1)
    for _ in range(ROUNDS):
        open_ = lengths[covered[lengths] < 1 - 1e-9]
        if not len(open_):
            break
        price, share = np.zeros(capacity + 1), open_ / capacity
        price[open_] = share * (1 + BONUS * share) * np.exp(-RATE * (covered[open_] - covered[open_].min()))
        last = _knapsack(price, capacity)
        taken = 0
        for seed in open_[np.argsort(covered[open_] - 1e-6 * open_, kind="stable")].tolist():
            held = Counter([seed, *_contents(capacity - seed, last)])
            if sum(x * k for x, k in held.items()) < capacity or any(covered[x] >= 1 - 1e-9 for x in held):
                continue
            step = min(need[x] * min(STEP, 1 - covered[x]) / k for x, k in held.items())
            for x, k in held.items():
                covered[x] += step * k / need[x]
            use[tuple(sorted(held.elements(), reverse=True))] += step
            taken += 1
            if taken == PER_ROUND:
                break
        if not taken:
            break
    return use


def rounded(use: Counter, demand: np.ndarray, capacity: int) -> Plan:
    """Whole counts: most used first, as often as used (once at least) while the
    demand lasts; then best-fit decreasing for the rest."""
    left, plan = demand.astype(np.int64).copy(), []
    for whole in (True, False):
        for held, x in sorted(use.items(), key=lambda t: (-sum(t[0]), -t[1], t[0])):
            items = Counter(held)
            room = min(int(left[k]) // c for k, c in items.items())
            n = min(room, int(x) if whole else 1)
            if n > 0:
                plan.append((held, n))
                for k, c in items.items():
                    left[k] -= n * c
    return plan + best_fit(left, capacity)


def solve(demand: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """demand[l] items of each length l -> (lengths in a sequence, how many such)."""
    plain = best_fit(demand, capacity)
    lp = rounded(fractional(demand, capacity), demand, capacity)
    return min(lp, plain, key=lambda plan: sum(n for _, n in plan))


def lower_bound(demand: np.ndarray, capacity: int = CAPACITY) -> int:
    lengths = np.arange(len(demand))
    return max(-(-int((lengths * demand).sum()) // capacity), int(demand[lengths > capacity // 2].sum()))


def _places(plan: Plan) -> np.ndarray:
    """Rows (length, first, sequence, offset): the items of a length from number
    ``first`` on go to sequences from ``sequence`` on, one to each."""
    rows, given, sequence = [], Counter(), 0
    for held, n in plan:
        offset = 0
        for length in held:
            rows.append((length, given[length], sequence, offset))
            given[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def _spread(spark: SparkSession, plan: Plan) -> DataFrame:
    """length, sequence_id, offset of every place in the plan's sequences. Use i of n
    of a configuration stands at (i + u) / n of the whole; ids rise with that. u differs
    between configurations (256 u: golden ratio), or those used once would all meet."""
    uses = np.array([n for _, n in plan], np.int64)
    sizes = np.array([len(held) for held, _ in plan], np.int64)
    lengths = np.array([x for held, _ in plan for x in held], np.int64)
    offsets = np.array([x for held, _ in plan for x in np.cumsum((0, *held[:-1])).tolist()], np.int64)
    ends, firsts, total = np.cumsum(uses), np.cumsum(sizes) - sizes, int(uses.sum())
    shift = ((np.arange(len(uses)) + 1) * 0.6180339887498949 % 1 * 256).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                number = batch.column(0)[a : a + 64].to_numpy()
                which = np.searchsorted(ends, number, side="right")
                ids = (256 * (number - ends[which] + uses[which]) + shift[which]) * total // (256 * uses[which]) * len(uses) + which
                n = sizes[which]
                at = np.repeat(firsts[which] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                yield pa.RecordBatch.from_arrays([pa.array(lengths[at]), pa.array(np.repeat(ids, n)), pa.array(offsets[at])], ["length", "sequence_id", "offset"])

    return spark.range(0, total, 1, partitions(spark)).mapInArrow(lean(run), "length long, sequence_id long, offset long")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (any columns; ``length`` <= capacity), in
    the order of __order if there is one.

    ``cut_pieces`` is read twice; give a written table.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for row in cut_pieces.groupBy("length").count().collect():  # at most `capacity` rows
        demand[row["length"]] = row["count"]
    if "__order" in cut_pieces.columns:
        places = number_within(_spread(cut_pieces.sparkSession, solve(demand, capacity)), ["length"], ["sequence_id", "offset"], "__n")
        ordered = number_within(cut_pieces, [], ["__order", "piece"], "__nth").drop("__order")
        numbered = number_within(ordered, ["length"], ["__nth"], "__number")
        here = (numbered["length"] == places["length"]) & (numbered["__number"] == places["__n"])
        put = cut(numbered.join(places, here).select(*(numbered[c] for c in ordered.columns), F.col("sequence_id").alias("__s"), "offset"))
        mean = F.sum(F.col("__nth") * F.col("length")) / F.sum("length")
        ranked = number_within(put.groupBy("__s").agg(mean.alias("__mean")), [], ["__mean", "__s"], "sequence_id")
        return put.join(ranked.select("__s", "sequence_id"), "__s").select(*(c for c in cut_pieces.columns if c != "__order"), "sequence_id", "offset")
    table = _places(solve(demand, capacity))
    numbered = number_within(cut_pieces, ["length"], ["doc_id", "piece"], "__number")
    schema = numbered.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 48) + table[:, 1]
        for batch in batches:
            at = batch.schema.names.index("__number")
            number, length = batch.column(at).to_numpy(), batch.column(batch.schema.names.index("length")).to_numpy()
            row = table[np.searchsorted(keys, (length.astype(np.int64) << 48) + number, side="right") - 1]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            names = [n for n in batch.schema.names if n != "__number"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(row[:, 2] + number - row[:, 1]), pa.array(row[:, 3])], [*names, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema if f.name != "__number")
    return numbered.mapInArrow(lean(run), f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, kind: str = "byte", end_id: int = 0, tokenizer_path: str | None = None, with_ids: bool = False, order: Column | None = None) -> DataFrame:
    """Pieces of all documents with their places."""
    written = cut(pieces(docs, capacity, kind, end_id, tokenizer_path, with_ids, order))
    packed = pack(written, capacity)
    drop_table(written)
    return packed
