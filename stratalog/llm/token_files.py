"""Token-id files: canonical length-limited Huffman coding.

``encode_table`` tokenizes whole texts once, counts ids globally, builds one
canonical code whose lengths are limited to ``MAX_BITS`` (package-merge), and
writes the ids in ascending doc_id order as files; ``decode_table`` reads them
back by table look-up.

Files, under one folder:

* ``codebook``: one row; ``lengths`` has one byte per id, the code's length in
  bits (0: the id doesn't occur). Canonical codes follow from the lengths:
  ascending by length, then id.
* ``shards``: rows (part, shard, start_in_part, n_tokens, doc_ids, doc_lengths,
  checkpoints, payload). ``payload`` is the bit stream, most significant bit
  first, padded to 8 bytes; ``checkpoints`` has the bit offset (8 bytes, little
  endian) of each block of BLOCK ids, so any block is decoded by itself. Shards
  of ascending part, then shard, hold ascending doc_ids.

The container is Parquet so that any store Spark writes to can hold the files
and a lost executor's half-written file is never read.

Memory: a task holds one shard (about SHARD_TOKENS ids, or one document) and
tables of 2^MAX_BITS entries. The driver holds one count per id of the
vocabulary and one total per part.

Defined results: a null or empty text is the end id alone; null doc_ids come
first; rows that share a doc_id are kept, in order of their ids; an empty table
gives empty files. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm.base import cut, drop_table, lean, partitions, scratch
from stratalog.llm.tokens import BATCH_CHARS, slices, tokenizer

MAX_BITS = 20
BLOCK = 1024
SHARD_TOKENS = 2_000_000

SHARD_SCHEMA = "part int, shard int, start_in_part long, n_tokens long, doc_ids binary, doc_nulls binary, doc_lengths binary, checkpoints binary, payload binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 where a count is 0.

    Package-merge: level by level, the cheapest pairs join the single symbols;
    as many of the cheapest items of the last level are taken as a complete code
    has, and each level's share of single symbols tells whose codes grow.
    """
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n <= 1:
        lengths[symbols] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} symbols need more than {limit} bits")
    by_count = symbols[np.argsort(counts[symbols], kind="stable")]
    single = counts[by_count].astype(np.float64 if counts.dtype.kind == "f" else np.int64)
    levels, items = [], single
    for level in range(limit):
        if level:
            even = len(items) // 2 * 2
            pairs = items[0:even:2] + items[1:even:2]
            items = np.concatenate([single, pairs])
            order = np.argsort(items, kind="stable")
            levels.append(order < n)
            items = items[order]
        else:
            levels.append(np.ones(n, bool))
    take, grown = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_single in reversed(levels):
        ones = int(is_single[:take].sum())
        grown[0] += 1
        grown[ones] -= 1
        take = 2 * (min(take, len(is_single)) - ones)
    lengths[by_count] = np.cumsum(grown)[:n]
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    sizes = lengths[order].astype(np.uint64)
    steps = np.uint64(1) << (np.uint64(MAX_BITS) - sizes)
    starts = np.cumsum(steps) - steps
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = starts >> (np.uint64(MAX_BITS) - sizes)
    return codes


def decoding_tables(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each MAX_BITS-bit window, the id it begins with and that code's length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    reach = np.int64(1) << (MAX_BITS - lengths[order].astype(np.int64))
    ids, bits = np.repeat(order, reach), np.repeat(lengths[order], reach)
    rest = (1 << MAX_BITS) - len(ids)  # of an incomplete code (a single id)
    return np.pad(ids, (0, rest)).astype(np.uint32), np.pad(bits, (0, rest), constant_values=1).astype(np.int64)


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The payload and the blocks' bit offsets."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    begin = end - size
    total = int(end[-1]) if len(ids) else 0
    words = np.zeros((total + 63) // 64 + 1, np.uint64)
    if len(ids):
        value, word, over = codes[ids], begin >> 6, (begin & 63) + size - 64
        fits = over <= 0
        high = np.where(fits, value << np.where(fits, -over, 0).astype(np.uint64), value >> np.where(fits, 0, over).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        spill = np.flatnonzero(over > 0)
        words[word[spill] + 1] |= value[spill] << (64 - over[spill]).astype(np.uint64)
    return words[: (total + 63) // 64].astype(">u8").tobytes(), begin[::BLOCK].astype("<u8").tobytes()


def unpack_bits(payload: bytes, checkpoints: bytes, n: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids; the blocks advance together, one id of each block at a time."""
    ids_of, bits_of = tables
    at = np.frombuffer(checkpoints, "<u8").astype(np.int64)
    words = np.concatenate([np.frombuffer(payload, ">u8").astype(np.uint64), np.zeros(2, np.uint64)])
    last = len(words) - 2
    out = np.empty((BLOCK, len(at)), np.uint32)
    for k in range(min(BLOCK, n)):
        word, bit = np.minimum(at >> 6, last), (at & 63).astype(np.uint64)
        window = ((words[word] << bit) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))) >> np.uint64(64 - MAX_BITS)
        window = window.astype(np.int64)
        out[k] = ids_of[window]
        at = at + bits_of[window]
    return out.T.reshape(-1)[:n] if n >= BLOCK else out[:n, 0].copy()


def tokenized(docs: DataFrame, kind: str, end_id: int, path: str | None = None) -> DataFrame:
    """doc_id and the packed ids of each whole text with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(kind, path)
        end = np.array([end_id], tok.code).tobytes()
        for batch in batches:
            keys, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(len(texts), [len(t) for t in texts], BATCH_CHARS):
                ids = [x + end for x in tok.encode(texts[a:b])]
                yield pa.RecordBatch.from_arrays([keys[a:b], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, ids binary")


def global_counts(ids: DataFrame, width: int, size: int) -> np.ndarray:
    """Occurrences of each id; one row per id reaches the driver."""
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                counts += np.bincount(np.frombuffer(b"".join(batch.column(0)[a : a + 512].to_pylist()), dtype), minlength=size)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    rows = ids.select("ids").mapInArrow(lean(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def encode_table(docs: DataFrame, path: str, kind: str = "word", end_id: int = 1, tokenizer_path: str | None = None) -> None:
    """Write the files of ``docs`` (doc_id, text) under ``path``."""
    spark = docs.sparkSession
    tok = tokenizer(kind, tokenizer_path)
    size, dtype = tok.tokenizer.get_vocab_size(), f"<u{tok.width}"
    ids = cut(tokenized(docs, kind, end_id, tokenizer_path))
    lengths = code_lengths(global_counts(ids, tok.width, size))
    spark.createDataFrame([(bytearray(lengths.tobytes()), MAX_BITS, BLOCK)], "lengths binary, max_bits int, block int").coalesce(1).write.parquet(f"{path}/codebook")
    raw = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(raw, np.uint8)
        codes, part = canonical_codes(bits), TaskContext.get().partitionId()
        start = shard = held = 0
        keys, texts = [], []

        def flush() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(texts), dtype)
            payload, checkpoints = pack_bits(tokens, codes, bits)
            row = [part, shard, start, len(tokens), np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is None for k in keys], "u1").tobytes(), np.array([len(x) // tok_width for x in texts], "<i8").tobytes(), checkpoints, payload]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        tok_width = np.dtype(dtype).itemsize
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and held + len(text) > SHARD_TOKENS * tok_width:
                    yield flush()
                    start, shard, held, keys, texts = start + held // tok_width, shard + 1, 0, [], []
                keys.append(key)
                texts.append(text)
                held += len(text)
        if texts:
            yield flush()

    # The ranges' second key splits rows that share a doc_id without sampling ids.
    ranged = ids.withColumn("__tie", F.crc32("ids")).repartitionByRange(partitions(spark), "doc_id", "__tie")
    ordered = ranged.sortWithinPartitions("doc_id", "__tie", "ids").select("doc_id", "ids")
    ordered.mapInArrow(lean(run), SHARD_SCHEMA).write.parquet(f"{path}/shards")
    drop_table(ids)


def decode_table(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """From the files: doc_id, start (ids before it in the files), n_tokens,
    ids_crc32 and, if wanted, ids (packed little-endian unsigned 32-bit)."""
    raw = bytes(spark.read.parquet(f"{path}/codebook").first()["lengths"])
    shards = spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards")
    # One total per part, as many as the writing job had tasks.
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for part, n in totals:
        before[part] = total
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = decoding_tables(np.frombuffer(raw, np.uint8))
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                ids = unpack_bits(r["payload"], r["checkpoints"], r["n_tokens"], tables)
                n = np.frombuffer(r["doc_lengths"], "<i8")
                ends = np.cumsum(n)
                cells = [ids[e - k : e].astype("<u4").tobytes() for e, k in zip(ends.tolist(), n.tolist())]
                columns = [
                    pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=np.frombuffer(r["doc_nulls"], "u1").astype(bool)),
                    pa.array(ends - n + before[r["part"]] + r["start_in_part"]),
                    pa.array(n),
                    pa.array([zlib.crc32(c) for c in cells], pa.int64()),
                    pa.array(cells, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns[: len(names)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids]
    return shards.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, kind: str = "word", end_id: int = 1, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Write the files in a new shared folder and read them back."""
    path = scratch(docs.sparkSession)
    encode_table(docs, path, kind, end_id, tokenizer_path)
    return decode_table(docs.sparkSession, path, with_ids)
