"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes: at each byte it is the sum of a random
number for each of the last 32 bytes, shifted by its distance. A chunk ends
where the hash's upper bits are zero: more bits are asked for before NORMAL
bytes than after it (normalised chunking), none before MINIMUM, and MAXIMUM ends
it anyway. As MINIMUM covers the hash's window, a boundary depends on the bytes
around it alone, so an insertion moves only the chunks it touches.

A fingerprint is the set of the chunks' 64-bit digests with the bytes each
stands for. ``containment(a, b)`` is the part of a's bytes whose chunks b has too.

Memory: a task holds a few million characters at once, or one text. Rows reach
tasks by ranges of doc_id; the driver holds one doc_id per range.

Defined results: a null or empty text has the empty fingerprint "", contained in
an empty one entirely (1.0) and in any other not at all (0.0); a null doc_id
comes before all others; rows that share a doc_id follow one another in order of
their texts; the last row's next is the first; one row is its own next. Columns
other than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.base import lean, partitions

MINIMUM, NORMAL, MAXIMUM = 32, 64, 256
#: Zero bits asked for before and after NORMAL bytes.
HARD, EASY = 7, 5
WINDOW = 32
#: Characters whose hashes a task computes at once, but for a longer text.
SLICE_CHARS = 2_000_000

ENTRY = np.dtype([("digest", "<u8"), ("size", "<u4")])

GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte, by doubling the window it covers."""
    h = GEAR[data]
    reach = 1
    while reach < WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)
        reach *= 2
    return h


def chunk_ends(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of every chunk; all texts advance together."""
    hard = np.flatnonzero(h >> np.uint32(32 - HARD) == 0)
    easy = np.flatnonzero(h >> np.uint32(32 - EASY) == 0)
    far = np.int64(1) << 60
    hard, easy = np.append(hard, far), np.append(easy, far)
    text, at = np.arange(len(starts)), starts.copy()
    text, at = text[at < ends], at[at < ends]
    found = []
    while len(text):
        stop = ends[text]
        # A boundary after byte p makes the chunk end at p + 1.
        first = hard[np.searchsorted(hard, at + MINIMUM - 1)] + 1
        later = easy[np.searchsorted(easy, at + NORMAL - 1)] + 1
        end = np.where(first < at + NORMAL, first, np.minimum(later, at + MAXIMUM))
        end = np.minimum(end, stop)
        found.append((text, at, end))
        more = end < stop
        text, at = text[more], end[more]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


class Prints:
    """Fingerprints of a list of texts: rows (text, digest, size), sorted."""

    def __init__(self, texts: list[bytes]):
        buffer = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        starts = ends - np.array([len(t) for t in texts], np.int64)
        # Hashes near a text's start see the text before it, but boundaries there
        # are ruled out by MINIMUM.
        text, begin, end = chunk_ends(gear_hashes(np.frombuffer(buffer, np.uint8)) if buffer else np.zeros(0, np.uint32), starts, ends)
        digest = np.fromiter((xxhash.xxh3_64_intdigest(buffer[a:b]) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(begin))
        order = np.lexsort((digest, text))
        text, digest, size = text[order], digest[order], (end - begin)[order]
        if len(text):
            first = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (digest[1:] != digest[:-1])))
            text, digest, size = text[first], digest[first], np.add.reduceat(size, first)
        self.n, self.text, self.digest, self.size = len(texts), text, digest, size

    def strings(self) -> list[str]:
        entries = np.empty(len(self.text), ENTRY)
        entries["digest"], entries["size"] = self.digest, self.size
        packed, bounds = entries.tobytes(), (np.searchsorted(self.text, np.arange(self.n + 1)) * ENTRY.itemsize).tolist()
        return [base64.b64encode(packed[a:b]).decode() for a, b in zip(bounds, bounds[1:])]

    def contained(self, mine: np.ndarray, other: Prints, theirs: np.ndarray) -> np.ndarray:
        """For each k, how much of text mine[k] is in other's text theirs[k]
        (no text twice in either list)."""

        def rows(p: Prints, chosen: np.ndarray):
            pair = np.full(p.n, -1)
            pair[chosen] = np.arange(len(chosen))
            k = pair[p.text]
            return k[k >= 0], p.digest[k >= 0], p.size[k >= 0]

        (k, d, s), (k2, d2, s2) = rows(self, mine), rows(other, theirs)
        own, both = np.bincount(k, s, len(mine)), np.bincount(k2, s2, len(mine))
        pair, digest, size = np.concatenate([k, k2]), np.concatenate([d, d2]), np.concatenate([s, s2])
        order = np.lexsort((digest, pair))
        pair, digest, size = pair[order], digest[order], size[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (digest[1:] == digest[:-1])) if len(pair) else np.zeros(0, int)
        shared = np.bincount(pair[same], np.minimum(size[same], size[same + 1]), len(mine))
        return np.where(own > 0, shared / np.maximum(own, 1), (both == 0).astype(float))


def fingerprint(text: str | None) -> str:
    return Prints([(text or "").encode()]).strings()[0]


def containment(a: str, b: str) -> float:
    """Part of the bytes of fingerprint ``a`` that are in ``b``."""
    x, y = (dict(np.frombuffer(base64.b64decode(s), ENTRY).tolist()) for s in (a, b))
    if not x:
        return float(not y)
    return sum(min(n, y.get(d, 0)) for d, n in x.items()) / sum(x.values())


def with_next(docs: DataFrame) -> DataFrame:
    """Rows in ascending doc_id dealt to explicit ranges; each range also gets
    the row that follows it (own = false), the last one the very first.

    Columns: id (null: the smallest), doc_id, text, own, last (the wrapped row).
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # One id per range reaches the driver.
    ranges = keyed.select("id").repartitionByRange(partitions(spark), "id").groupBy(F.spark_partition_id()).agg(F.min("id").alias("id"))
    starts = sorted(r["id"] for r in ranges.collect())
    if not starts:
        starts = [0]
    width = max(1, int(len(starts) ** 0.5))
    groups = [starts[i : i + width] for i in range(0, len(starts), width)]
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    not_after = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("id")))
    # A search in two steps: the group of ranges, then the range.
    keyed = keyed.withColumn("__g", F.greatest(not_after(longs([g[0] for g in groups])) - 1, F.lit(0)))
    keyed = keyed.withColumn("__b", F.col("__g") * width + not_after(F.get(F.array(*(longs(g) for g in groups)), F.col("__g"))) - 1)
    begins = F.col("id").isin(starts)
    place = lambda bucket, own, last: F.struct(bucket.cast("int").alias("bucket"), F.lit(own).alias("own"), F.lit(last).alias("last"))
    places = F.array(
        place(F.col("__b"), True, False),
        F.when(begins & (F.col("__b") > 0), place(F.col("__b") - 1, False, False)),
        F.when(F.col("id") == starts[0], place(F.lit(len(starts) - 1), False, True)),
    )
    dealt = keyed.select("id", "doc_id", "text", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p"))
    dealt = dealt.select("id", "doc_id", "text", "p.own", "p.last", "p.bucket").repartitionById(len(starts), F.col("bucket"))
    return dealt.sortWithinPartitions("last", "id", "text").drop("bucket")


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited text (the last half of the
    code points replaced by the first as many of the next row), and how much of
    its own fingerprint the edited text's and the next row's contain."""

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def groups(batches: Iterator[pa.RecordBatch]):
        """Lists of consecutive rows; each begins with the last row of the one before."""
        held, size = [], 0
        for row in rows(batches):
            held.append(row)
            size += len(row[2])
            if size > SLICE_CHARS and len(held) > 1:
                yield held
                held, size = [row], len(row[2])
        if len(held) > 1:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in groups(batches):
            texts = [r[2] for r in held]
            # Of a range only its own rows; the one after them is there as a next.
            own = [i for i in range(len(held) - 1) if held[i][3]]
            if not own:
                continue
            edited = [(t[: len(t) - len(t) // 2] + texts[i + 1][: len(t) // 2]).encode() for i in own for t in [texts[i]]]
            a, b = Prints([t.encode() for t in texts]), Prints(edited)
            mine, strings = np.array(own), a.strings()
            columns = [
                pa.array([held[i][1] for i in own], pa.int64()),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array([strings[i] for i in own]),
                pa.array(b.strings()),
                pa.array(a.contained(mine, b, np.arange(len(own)))),
                pa.array(a.contained(mine, a, mine + 1)),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COLUMNS.split(", ")])

    return with_next(docs).mapInArrow(lean(run), COLUMNS)
