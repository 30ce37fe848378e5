"""Exact n-gram Jaccard join by a token-group matrix.

Documents are sets of word 5-grams (64-bit hashes); two link when
100 * |intersection| >= 75 * |union|. Steps, each exact (none loses a link):

1. ``screen``: all documents as one group. Of the smallest third of a set's
   hashes, a linked set shares at least a sixteenth of the set's size with
   others (prefix lemma, see ``prefix_sizes``). Hashes go to buckets as packed
   arrays; a bucket keeps those that occur twice; sets with too few of them link
   with nothing and are done. Sets equal to another are one class from here on.
   A second screen, over the classes that are left, uses whole sets.
2. Groups: classes with the same minimum hash (of two orders) are compared with
   the least of them, and the components of those links are the groups of
   similar documents. Minimum hashes of more orders gather what is alike without
   being linked, so that few groups hold the tokens that many sets share.
3. Matrix: sets of about one size are dealt to blocks of similar ones, those of a
   large component to its own. A token-group matrix holds which blocks hold a
   token. A set whose tokens held by other components' sets of a size class are
   fewer than any link with that class needs is done. For the others, the rarest
   tokens of which a linked set must hold one give (query, block) candidates; the
   overlap with the block's token union bounds the overlap with each member, and
   only qualifying blocks are opened and their members compared exactly. Of two
   components the members of the smaller one are the queries.
4. Components of all links found. Copies and near copies are never expanded
   into pairs; no partner or candidate is capped.

Memory: a bucket's arrays, or one document, or what QUERIES queries and a block's
members hold. Buckets are as many as spark.sql.shuffle.partitions, and more where
a bucket's share of the input would exceed BUCKET_BYTES or, when blocks are opened,
PAIRS pairs; they are salted by SALT_ENTRIES. A popular block's queries are dealt to
many tasks, each with the block's members. A hash adds two entries per map task
at most to a bucket's count, however frequent it is. The driver sees one count
per bucket.

Defined results: without words or text the set is empty, the document is linked
with nothing and is its own component; rows that share a doc_id are one node,
linked by any of its texts, each with its own set size; a null doc_id gets its
set size and a null component; an empty table gives an empty table. Columns other
than doc_id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.base import cut, drop_table, join_counted, lean, number_within, partitions
from stratalog.llm.components import components

WORDS = 5
#: Link: LIKE[0] * intersection >= LIKE[1] * union.
LIKE = (100, 75)
#: Entries of packed arrays that a map task holds, and that a bucket's task gets.
FLUSH_ENTRIES, SALT_ENTRIES = 2_000_000, 2_000_000

#: Bytes of input that a bucket stands for at most, as Spark estimates them.
BUCKET_BYTES = 64 << 20

#: Ratio of the sizes of a class; members of a block.
CLASS_RATIO, BLOCK = 1.1, 256
#: Queries of a block that a task opens it for, and (query, block) pairs of a bucket.
QUERIES, PAIRS = 128, 2048

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: Orders of hashes: multiplication by an odd number. Sets with the same minimum in
#: one of the first two are compared; all tell which sets go to one block.
_ORDERS = np.array([1, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)
COMPARED = 2


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of a text's word 5-grams, A-Z in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    g = h[:n] * _MIX[0]
    for k in range(1, WORDS):
        g ^= g >> np.uint64(31)
        g = (g + h[k : k + n]) * _MIX[k]
    g ^= g >> np.uint64(32)
    return np.unique(g)


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, a few hundred Python objects at a time."""
    for a in range(0, batch.num_rows, 256):
        yield from zip(*(c[a : a + 256].to_pylist() for c in batch.columns))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if not len(small) or LIKE[0] * len(small) < LIKE[1] * len(large):
        return False
    both = overlap(small, large)
    return LIKE[0] * both >= LIKE[1] * (len(a) + len(b) - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def least_overlap(n):
    """ceil(3 n / 4): a linked set shares that many of a set's n elements."""
    return -(-LIKE[1] * n // LIKE[0])


def prefix_sizes(n: int) -> tuple[int, int]:
    """(how many of the smallest hashes to look at, how many of them are shared).

    Sets a and b that share k elements have l common elements among their
    |a| - k + l and |b| - k + l smallest. With k = least_overlap and
    l = max(1, size // 12) for each, the smaller l of the two counts; a partner
    has at least three quarters of the size.
    """
    return n - least_overlap(n) + max(1, n // 12), max(1, least_overlap(n) // 12)


def _sets(binary: bytes) -> np.ndarray:
    return np.frombuffer(binary, "<u8")


BLOBS = "part long, idx int, id long, n long, d1 long, d2 long, bucket int, keys binary, rows binary"


def _blobs(source: DataFrame, n_buckets: int, whole: bool) -> DataFrame:
    """One row per document (bucket null) and packed bucket rows, in one pass.

    ``source``: (doc_id, text) or, if ``whole``, (id, tokens). ``keys`` are sorted
    32-bit hashes within the bucket, ``rows`` the documents' idx in the part.
    """
    names = [c.split()[0] for c in BLOBS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]

    def batch_of(height: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(height, t) for k, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 24
        docs, held, entries, seen = [], [], 0, set()

        def flush():
            yield batch_of(len(docs), **dict(zip(("part", "idx", "id", "n", "d1", "d2"), zip(*docs))))
            if held:
                tokens = np.concatenate([t for _, t in held]) * _MIX[3]
                rows = np.repeat(np.array([i for i, _ in held], np.uint32), [len(t) for _, t in held])
                bucket = ((tokens >> np.uint64(32)) % np.uint64(n_buckets)).astype(np.uint64)
                keys = tokens & np.uint64(0xFFFFFFFF)
                order = np.argsort((bucket << np.uint64(32)) | keys, kind="stable")
                bucket, keys, rows = bucket[order], keys[order].astype("<u4"), rows[order].astype("<u4")
                used, first = np.unique(bucket, return_index=True)
                bounds = [*first.tolist(), len(keys)]
                blobs = [(keys[a:b].tobytes(), rows[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])]
                for k in range(0, len(blobs), 64):
                    some = blobs[k : k + 64]
                    yield batch_of(len(some), part=[part] * len(some), bucket=used[k : k + 64].astype(np.int32), keys=[x for x, _ in some], rows=[x for _, x in some])

        for batch in batches:
            for key, value in rows_of(batch):
                s = _sets(value) if whole else shingles(value)
                digest = xxhash.xxh3_128_digest(s.tobytes())
                d1, d2 = np.frombuffer(digest, "<i8").tolist()
                idx = len(docs)
                docs.append((part, idx, key, len(s), d1, d2))
                if len(s) and digest not in seen:
                    seen.add(digest)
                    size = len(s) if whole else prefix_sizes(len(s))[0]
                    held.append((idx, s[:size]))
                    entries += size
                if entries > FLUSH_ENTRIES or len(docs) >= 1 << 20:
                    yield from flush()
                    docs, held, entries, seen, part = [], [], 0, set(), part + 1
        if docs:
            yield from flush()

    return source.mapInArrow(lean(run), BLOBS)


def _buckets(source: DataFrame) -> int:
    """Results don't depend on it. The estimate is of the files' size; where there
    is none, it is huge and says nothing."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(source.sparkSession), -(-size // BUCKET_BYTES) if size < 1 << 60 else 0)


def _shared(blobs: DataFrame) -> DataFrame:
    """(bucket, shared, entries): keys that occur twice in a bucket, sorted."""

    def at_most_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, sizes = [], []
            for value in batch.column(1):
                k = np.frombuffer(value.as_py(), "<u4")
                out.append(k[np.append([True, True], k[2:] != k[:-2])[: len(k)]].tobytes())
                sizes.append(len(k))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], ["bucket", "keys", "entries"])

    def twice(table: pa.Table) -> pa.Table:
        k = np.sort(np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["keys"]]))
        both = np.unique(k[1:][k[1:] == k[:-1]])
        total = int(np.sum(table["entries"].to_numpy()))
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()), "shared": pa.array([both.astype("<u4").tobytes()], pa.binary()), "entries": pa.array([total], pa.int64())})

    packed = blobs.where("bucket IS NOT NULL").select("bucket", "keys").mapInArrow(lean(at_most_two), "bucket int, keys binary, entries long")
    return cut(packed.groupBy("bucket").applyInArrow(twice, "bucket int, shared binary, entries long"))


def _hits(blobs: DataFrame, shared: DataFrame) -> DataFrame:
    """(part, idx, hits): each document's keys that are shared."""
    salts = {r["bucket"]: -(-r["entries"] // SALT_ENTRIES) for r in shared.select("bucket", "entries").collect()}
    table = F.create_map(*(F.lit(x) for b, s in salts.items() if s > 1 for x in (b, int(s)))) if any(s > 1 for s in salts.values()) else None
    n_salts = F.coalesce(F.try_element_at(table, F.col("bucket")), F.lit(1)) if table is not None else F.lit(1)
    left = blobs.where("bucket IS NOT NULL").select("bucket", "part", "keys", "rows").withColumn("salt", F.pmod(F.xxhash64("part"), n_salts).cast("int"))
    right = shared.select("bucket", "shared", F.explode(F.sequence(F.lit(0), (n_salts - 1).cast("int"))).alias("salt"))

    def count(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        both = np.frombuffer(theirs["shared"][0].as_py(), "<u4") if theirs.num_rows else np.zeros(0, "<u4")
        parts, found = [], []
        for part, keys, idx in zip(mine["part"].to_pylist(), mine["keys"], mine["rows"]):
            keys, idx = np.frombuffer(keys.as_py(), "<u4"), np.frombuffer(idx.as_py(), "<u4")
            if len(both):
                at = np.searchsorted(both, keys)
                at[at == len(both)] = 0
                parts.append(part)
                found.append(idx[both[at] == keys].tobytes())
        return pa.table({"part": pa.array(parts, pa.int64()), "found": pa.array(found, pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        idx, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table["found"]]), return_counts=True)
        return pa.table({"part": pa.array(np.full(len(idx), table["part"][0].as_py(), np.int64)), "idx": pa.array(idx.astype(np.int32)), "hits": pa.array(n.astype(np.int64))})

    found = left.groupBy("bucket", "salt").cogroup(right.groupBy("bucket", "salt")).applyInArrow(count, "part long, found binary")
    # A part's idx are those of one map task's documents, so this group is bounded.
    return found.groupBy("part").applyInArrow(total, "part long, idx int, hits long")


def _needed(n, whole: bool):
    at_least = F.expr(f"({LIKE[1]} * {n} + {LIKE[0] - 1}) div {LIKE[0]}")
    return at_least if whole else F.greatest(F.lit(1), F.floor(at_least / 12))


def screen(blobs: DataFrame, shared: DataFrame, whole: bool) -> DataFrame:
    """Rows of ``blobs`` (id, n, d1, d2) that can link with another class."""
    hits = _hits(blobs, shared)
    docs = blobs.where("bucket IS NULL").select("part", "idx", "id", "n", "d1", "d2")
    return docs.join(hits, ["part", "idx"]).where(F.col("hits") >= _needed("n", whole)).select("id", "n", "d1", "d2")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sets link; ``sets``: (id, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(_sets(x.as_py()), _sets(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta")), "a")
    with_b = with_a.join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb")), "b")
    return with_b.select("a", "b", "ta", "tb").mapInArrow(lean(run), "a long, b long").distinct()


def _groups(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links among similar sets, (id, g, lead) for every set): g is the
    component by those links, lead the least id with the same minimum hash in any
    order."""

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tokens = batch.column(0).to_pylist(), [_sets(x.as_py()) for x in batch.column(1)]
            for k, by in enumerate(_ORDERS):
                least = np.array([(t * by).min() for t in tokens], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([k] * len(ids), pa.int64()), pa.array(least)], ["id", "k", "least"])

    keys = cut(sets.select("id", "tokens").mapInArrow(lean(minima), "id long, k long, least long"))
    heads = keys.groupBy("k", "least").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"))
    headed = cut(join_counted(keys, heads, ["k", "least"], "n", ["id"], keys.count()).select("id", "k", "a"))
    links = cut(_verified(headed.where(f"a <> id AND k < {COMPARED}").select("a", F.col("id").alias("b")).distinct(), sets))
    leads = headed.groupBy("id").agg(F.min("a").alias("lead"))
    named = leads.join(components(links), "id", "left").select("id", F.coalesce("component", "id").alias("g"), "lead")
    groups = cut(named)
    for table in (keys, headed):
        drop_table(table)
    return links, groups


def _described(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """id, n, tokens with ord (the component's number, the largest first), c (size
    class) and block (of at most about BLOCK similar sets of one class)."""
    components_ = groups.groupBy("g").agg(F.count(F.lit(1)).alias("members"), (-F.count(F.lit(1))).alias("__less"))
    ordered = number_within(components_, [], ["__less", "g"], "ord")
    numbered = ordered.select("g", "ord", "members")
    c = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(CLASS_RATIO)))).cast("int")
    label = F.when(F.col("members") >= BLOCK // 4, -1 - F.col("ord")).otherwise(F.col("lead"))
    rows = cut(groups.join(numbered, "g").join(sets.select("id", "n"), "id").select("id", "ord", c.alias("c"), label.alias("label")))
    drop_table(ordered)
    counted = rows.groupBy("label", "c").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("salts"))
    salt = F.pmod(F.xxhash64("id"), F.col("salts"))
    blocks = rows.join(counted, ["label", "c"]).select("id", "ord", "c", F.xxhash64("label", "c", salt).alias("block"))
    described = cut(sets.join(blocks, "id").select("id", "n", "ord", "c", "block", "tokens"))
    drop_table(rows)
    return described


def class_floor(c: int) -> int:
    """A size that no set of class ``c`` is below."""
    return max(1, int(CLASS_RATIO ** c * (1 - 1e-9)))


def _bound(n, least):
    """Least overlap of linked sets of sizes n and at least ``least`` (columns)."""
    return F.expr(f"({LIKE[1]} * ({n} + {least}) + {sum(LIKE) - 1}) div {sum(LIKE)}")


def _across(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between different components, by the token-group matrix. Each is
    looked for from the smaller component's side (the larger ord)."""
    spark = sets.sparkSession
    described = _described(sets, groups)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "n", "ord", "c", "block"]
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                tokens = [_sets(x.as_py()) for x in part.column(5)]
                n = np.array([len(t) for t in tokens])
                columns = [pa.array(np.repeat(part.column(i).to_numpy(), n)) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(tokens).view(np.int64))], [*names, "token"])

    entries = described.mapInArrow(lean(rows), "id long, n long, ord long, c int, block long, token long")
    # How many sets of a size class hold a token, and the largest component that does.
    held = entries.groupBy("token", F.col("c").alias("hc")).agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("holders"))
    floors = F.create_map(*(F.lit(x) for c in range(_classes_of(described)) for x in (c, class_floor(c))))
    least = F.greatest(F.try_element_at(floors, F.col("hc")).cast("long"), F.expr(f"({LIKE[1]} * n + {LIKE[0] - 1}) div {LIKE[0]}"))
    top = F.try_element_at(floors, F.col("hc")) * LIKE[1] <= F.col("n") * LIKE[0]
    near = F.col("hc") >= F.col("c") - int(np.ceil(np.log(LIKE[0] / LIKE[1]) / np.log(CLASS_RATIO))) - 1
    abroad = cut(entries.select("id", "n", "ord", "c", "token").join(held, "token").where(top & near & (F.col("first") < F.col("ord"))).withColumn("least", least).select("id", "n", "ord", "hc", "least", "token", "holders"))
    counts = abroad.groupBy("id", "hc").agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n"), F.first("least").alias("least")).withColumn("need", _bound("n", "least"))
    passed = counts.where("hits >= need").select("id", "hc", (F.col("hits") - F.col("need") + 1).alias("spare"))
    # Of any n - need + 1 tokens a linked set holds one; those that no set of the
    # class holds count among them, so the rarest `spare` others do.
    nth = F.row_number().over(Window.partitionBy("id", "hc").orderBy("holders", "token"))
    rare = cut(abroad.join(passed, ["id", "hc"]).withColumn("nth", nth).where("nth <= spare").select("id", "ord", "hc", "token"))
    drop_table(abroad)
    wanted = rare.select("token", F.col("hc").alias("c")).distinct()
    matrix = entries.select("token", "c", "block", "ord").join(wanted, ["token", "c"], "left_semi").groupBy("token", "c", "block").agg(F.min("ord").alias("first"))
    asked = rare.join(matrix.withColumnRenamed("c", "hc"), ["token", "hc"]).where(F.col("first") < F.col("ord")).select("id", "block").distinct()
    pairs = cut(asked)
    drop_table(rare)
    # A block is opened for QUERIES queries at once: they and a copy of its members
    # are one part, and parts are dealt to buckets.
    parts = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    n_buckets = max(4 * partitions(spark), -(-pairs.count() // PAIRS))
    bucket = F.pmod(F.xxhash64("block", "salt"), F.lit(n_buckets)).cast("int")
    salted = pairs.join(parts, "block").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    queries = salted.join(described.select("id", "ord", "tokens"), "id").select(bucket.alias("bucket"), F.xxhash64("block", "salt").alias("block"), "id", "ord", "tokens")
    copies = parts.select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    held_ = described.join(copies, "block").withColumn("bucket", bucket).withColumn("block", F.xxhash64("block", "salt"))
    members = held_.select(F.col("bucket").alias("m_bucket"), *(F.col(x).alias(f"m_{x}") for x in ("block", "id", "ord", "tokens")))

    def opened(q: pa.Table, m: pa.Table) -> pa.Table:
        found: list[tuple[int, int]] = []
        of: dict[int, list] = {}
        for block, key, ord_, tokens in zip(*(m[x].to_pylist() for x in ("m_block", "m_id", "m_ord", "m_tokens"))):
            of.setdefault(block, []).append((key, ord_, _sets(tokens)))
        ask: dict[int, list] = {}
        for block, key, ord_, tokens in zip(*(q[x].to_pylist() for x in ("block", "id", "ord", "tokens"))):
            ask.setdefault(block, []).append((key, ord_, _sets(tokens)))
        for block, queries in ask.items():
            sets_ = of.get(block, [])
            if not sets_:
                continue
            keys, ords, sizes = (np.array(x) for x in ([k for k, _, _ in sets_], [o for _, o, _ in sets_], [len(t) for _, _, t in sets_]))
            whole = np.concatenate([t for _, _, t in sets_])
            order = np.argsort(whole, kind="stable")
            tokens, holder = whole[order], np.repeat(np.arange(len(sets_)), sizes)[order]
            for key, ord_, t in queries:
                a, b = np.searchsorted(tokens, t), np.searchsorted(tokens, t, side="right")
                # The bound: tokens that any member holds.
                if sum(LIKE) * int((b > a).sum()) < LIKE[1] * (len(t) + int(sizes.min())):
                    continue
                n = b - a
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                both = np.bincount(holder[at], minlength=len(sets_))
                good = (LIKE[0] * both >= LIKE[1] * (len(t) + sizes - both)) & (ords < ord_)
                # One link into each component joins it.
                for k in np.unique(ords[good], return_index=True)[1]:
                    found.append((int(keys[good][k]), key))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    found = cut(queries.groupBy("bucket").cogroup(members.groupBy("m_bucket")).applyInArrow(opened, "a long, b long"))
    for table in (pairs, described):
        drop_table(table)
    return found


def _classes_of(described: DataFrame) -> int:
    """One more than the largest size class: a logarithm of the largest set."""
    return int(described.agg(F.max("c")).first()[0] or 0) + 1


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blobs = cut(_blobs(texts, _buckets(docs.select("text")), False))
    rows = cut(blobs.where("bucket IS NULL").select("id", "n", "d1", "d2"))
    classes = cut(rows.where("id IS NOT NULL AND n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.max("id").alias("top")))
    shared = _shared(blobs)
    left = cut(screen(blobs, shared, False).join(classes, ["d1", "d2"]).select(F.col("rep").alias("doc_id")).distinct())
    for table in (blobs, shared):
        drop_table(table)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                s = [shingles(t) for t in batch.column(1)[a : a + 1000].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a : a + 1000], pa.array([len(x) for x in s], pa.int64()), pa.array([x.tobytes() for x in s], pa.binary())], ["id", "n", "tokens"])

    # By shuffle at every size: what is left grows with the documents.
    some = cut(texts.join(left.hint("merge"), "doc_id").select("doc_id", "text").mapInArrow(lean(sets_of), "id long, n long, tokens binary").where("n > 0"))
    again = cut(_blobs(some.select("id", "tokens"), _buckets(some.select("tokens")), True))
    shared = _shared(again)
    sets = cut(some.join(screen(again, shared, True).select("id").distinct(), "id", "left_semi"))
    for table in (left, some, again, shared):
        drop_table(table)
    links, groups = _groups(sets)
    # Equal sets: every row of a class links with its representative, as do the
    # classes that one repeated doc_id belongs to.
    copies = rows.join(classes.where("rep <> top"), ["d1", "d2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    across = _across(sets, groups)
    # The groups are the components of the links among them: stars already.
    stars = groups.select(F.col("g").alias("a"), F.col("id").alias("b"))
    found = components(stars.union(across).union(copies))
    # What is left reads rows and components only.
    for table in (sets, groups, links, across, classes):
        drop_table(table)
    named = rows.join(found, "id", "left")
    return named.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
