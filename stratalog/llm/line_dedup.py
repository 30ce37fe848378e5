"""Line dedup: repeated runs of lines by prefix doubling over line ids.

A text is the sequence of its lines that have a word (white space at their ends
doesn't count; a blank line goes with the line before it). A run of lines with
MIN_WORDS words or more that stands elsewhere before, in ascending (doc_id, line)
order, is a later copy, and its lines are deleted. The earlier copy must end before
the later one begins, so a line repeated without end keeps its first MIN_WORDS
words. Every deleted line is equal to an earlier one that is kept.

1. Texts equal to an earlier one are later copies as a whole; of each class only
   the first goes on.
2. Prefix doubling: rank k of a line position is the place, in sorted order, of
   the 2^k lines from there among all repeated such runs; rank k + 1 sorts pairs
   of ranks k at positions 2^k apart. Positions whose run occurs once drop out, so
   levels shrink fast. Sorting is by ranges, no level is gathered anywhere.
3. Suffixes that share their first m lines are an interval of the suffix array
   with longest common prefix >= m, named by the ranks k at both ends of the run
   (2^k <= m < 2^(k+1)). Of each position, the shortest run of MIN_WORDS words
   that begins or ends there is looked up; as a line has a word at least, m is at
   most MIN_WORDS and log2(MIN_WORDS) levels do. The maximal repeated runs are
   exactly the unions of those whose interval has an earlier member that doesn't
   overlap; the first member is one if any is.

Memory: a task holds one text's lines, or a batch of positions. The driver sees
one count per level.

Defined results: a null or empty text has no lines and stays as it is; rows equal
in doc_id and text are the same document and keep the same lines; a null doc_id
comes first; ties go to the smaller hash of the text, then the earlier line.
Other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.base import SPACE_CHARS, SPACE_CLASS, cut, drop_table, join_counted, lean, number_within

MIN_WORDS = 50
#: Positions that a task looks up at once, but for a longer text.
BATCH_ROWS = 400_000


def _keys() -> dict:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "t1": F.xxhash64(text), "t2": F.xxhash64(F.lit("second"), text)}


def _sequences(docs: DataFrame) -> DataFrame:
    """id, t1, t2 and the worded lines: struct (h1, h2, words) each."""
    lines = F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), lambda x: F.trim(x, F.lit(SPACE_CHARS)))
    worded = F.filter(lines, lambda x: x != "")
    entry = lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit("second"), x).alias("h2"), F.size(F.split(x, SPACE_CLASS + "+")).alias("w"))
    return docs.select(*(c.alias(k) for k, c in _keys().items()), F.transform(worded, entry).alias("lines")).distinct()


def _ranked(pairs: DataFrame, first: str, second: str, *columns: str) -> DataFrame:
    """Rows of ``pairs`` whose (first, second) is repeated, with its ``rank``: its
    number, in sorted order, among the repeated ones."""
    repeated = pairs.groupBy(first, second).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    numbered = number_within(repeated, [], [first, second], "rank")
    names = cut(numbered)
    drop_table(numbered)
    found = join_counted(pairs, names, [first, second], "n", ["id", "seq"], pairs.count())
    out = cut(found.where("rank IS NOT NULL").select("id", "t1", "seq", "rank", *columns))
    drop_table(names)
    return out


def levels(positions: DataFrame, top: int) -> list[DataFrame]:
    """Ranks 0 to ``top``: (id, t1, seq, rank) of positions of repeated runs of
    2^k lines; the first also has ``before`` and ``w``, words before and in the
    line. ``positions``: id, t1, seq, h1, h2, before, w."""
    out = [_ranked(positions, "h1", "h2", "before", "w")]
    for k in range(top):
        there = Window.partitionBy("id", "t1").orderBy("seq").rangeBetween(1 << k, 1 << k)
        pairs = cut(out[-1].select("id", "t1", "seq", F.col("rank").alias("r1"), F.first("rank").over(there).alias("r2")).where("r2 IS NOT NULL"))
        level = _ranked(pairs, "r1", "r2")
        drop_table(pairs)
        if level.isEmpty():
            break
        out.append(level)
    return out


def _windows(ranks: list[DataFrame], min_words: int) -> DataFrame:
    """id, t1, a, m, r1, r2: the shortest runs of ``min_words`` words that begin
    or end at a position, named by their ranks."""

    def named(rows: pa.Table) -> pa.RecordBatch:
        cols = {n: rows[n].to_numpy() for n in ("id", "t1", "seq", "rank", "k")}
        at = np.append(True, (np.diff(cols["id"]) != 0) | (np.diff(cols["t1"]) != 0))
        doc = np.cumsum(at) - 1
        base = cols["k"] == 0
        d, seq = doc[base], cols["seq"][base]
        before = pc.fill_null(rows["before"], 0).to_numpy()[base]
        end = before + pc.fill_null(rows["w"], 0).to_numpy()[base]
        # An island: consecutive lines of a text that are all repeated.
        island = np.cumsum(np.append(True, (np.diff(d) != 0) | (np.diff(seq) != 1)))
        wide = np.int64(1) << 40
        n = np.arange(len(seq))
        last = np.searchsorted(island * wide + end, island * wide + before + min_words)
        first = np.searchsorted(island * wide + before, island * wide + end - min_words, side="right") - 1
        inside = lambda x: (x >= 0) & (x < len(seq)) & (island[np.clip(x, 0, max(len(seq) - 1, 0))] == island)
        ok_last, ok_first = inside(last), inside(first) & (first >= 0)
        ok_first &= end - before[np.clip(first, 0, None)] >= min_words
        a = np.concatenate([n[ok_last], first[ok_first]])
        b = np.concatenate([last[ok_last], n[ok_first]])
        a, b = (np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)).astype(np.int64)
        m = b - a + 1
        k = np.floor(np.log2(np.maximum(m, 1))).astype(np.int64)
        # Look both ends' ranks up by (level, text, line).
        line = lambda k, d, s: (k * (doc[-1] + 1) + d) * (np.int64(1) << 32) + s
        keys = line(cols["k"].astype(np.int64), doc, cols["seq"])
        order = np.argsort(keys, kind="stable")
        keys, rank = keys[order], cols["rank"][order]

        def look(want):
            where = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            return keys[where] == want, rank[where]

        f1, r1 = look(line(k, d[a], seq[a]))
        f2, r2 = look(line(k, d[a], seq[b] - (np.int64(1) << k) + 1))
        ok = f1 & f2
        ids, t1 = cols["id"][base], cols["t1"][base]
        values = [ids[a][ok], t1[a][ok], seq[a][ok], m[ok], r1[ok], r2[ok]]
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in values], ["id", "t1", "a", "m", "r1", "r2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < BATCH_ROWS:
                continue
            ids, t1 = held["id"].to_numpy(), held["t1"].to_numpy()
            # The last text may go on in the next batch.
            changes = np.flatnonzero((np.diff(ids) != 0) | (np.diff(t1) != 0))
            if len(changes):
                stop = int(changes[-1]) + 1
                yield named(held.slice(0, stop).combine_chunks())
                held = held.slice(stop)
        if held is not None and held.num_rows:
            yield named(held.combine_chunks())

    whole = None
    for k, level in enumerate(ranks):
        part = level.select("id", "t1", F.lit(k).alias("k"), F.col("seq").cast("long").alias("seq"), "rank", *((F.col(c).cast("long").alias(c) if k == 0 else F.lit(None).cast("long").alias(c)) for c in ("before", "w")))
        whole = part if whole is None else whole.union(part)
    dealt = whole.repartition("id", "t1").sortWithinPartitions("id", "t1", "k", "seq")
    return dealt.mapInArrow(lean(run), "id long, t1 long, a long, m long, r1 long, r2 long")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, t1, runs): runs of worded lines to delete, arrays of (a, m)."""
    sequences = cut(_sequences(docs))
    words = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + x["w"])
    # Classes of equal texts, and how many rows have them, as a small table: the
    # joins below must not run the aggregate again, and split hot classes.
    classes = cut(sequences.groupBy("t1", "t2").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    known = join_counted(sequences, classes, ["t1", "t2"], "n", ["id"], sequences.count())
    is_copy = F.coalesce(F.col("id") != F.col("head"), F.lit(False))
    copies = known.where(is_copy & (words >= min_words)).select("id", "t1", F.lit(0).cast("long").alias("a"), F.size("lines").cast("long").alias("m"))
    ahead = Window.partitionBy("id", "t1").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    lines = known.where(~is_copy).select("id", "t1", F.posexplode("lines").alias("seq", "line")).select("id", "t1", "seq", "line.*")
    positions = cut(lines.withColumn("before", F.coalesce(F.sum("w").over(ahead), F.lit(0))))
    ranks = levels(positions, max(0, min_words.bit_length() - 1))
    runs = cut(_windows(ranks, min_words))
    here = F.struct("id", "t1", "a")
    heads = cut(runs.groupBy("m", "r1", "r2").agg(F.min(here).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    named = join_counted(runs, heads, ["m", "r1", "r2"], "n", ["id", "a"], runs.count())
    same_text = (F.col("id") == F.col("head.id")) & (F.col("t1") == F.col("head.t1"))
    later = named.where((here > F.col("head")) & ~(same_text & (F.col("a") < F.col("head.a") + F.col("m")))).select("id", "t1", "a", "m")
    # A text has two runs per line at most.
    found = cut(later.union(copies).groupBy("id", "t1").agg(F.collect_list(F.struct("a", "m")).alias("runs")))
    for table in (sequences, classes, positions, *ranks, runs, heads):
        drop_table(table)
    return found


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, report: bool = False) -> DataFrame:
    """``docs`` with later copies deleted from ``text``; ``report`` adds n_lines,
    n_deleted (worded lines) and deleted_words."""
    found = later_copies(docs, min_words).select(F.col("id").alias("__id"), F.col("t1").alias("__t1"), F.col("runs").alias("__runs"))
    key = _keys()
    # By shuffle at every size: what is found grows with the documents.
    marked = docs.withColumn("text", F.col("text").cast("string")).join(found.hint("merge"), (key["id"] == F.col("__id")) & (key["t1"] == F.col("__t1")), "left").drop("__id", "__t1")
    kept = [f for f in marked.schema.fields if f.name != "__runs"]
    extra = ["n_lines", "n_deleted", "deleted_words"] * report

    def clean(text: str | None, runs) -> tuple:
        lines = (text or "").split("\n")
        worded = [bool(x.strip(SPACE_CHARS)) for x in lines]
        n = sum(worded)
        if not runs:
            return text, n, 0, 0
        edge = np.zeros(n + 1, np.int64)
        for r in runs:
            edge[r["a"]] += 1
            edge[r["a"] + r["m"]] -= 1
        gone = np.cumsum(edge[:n]) > 0
        out, at, deleting, words = [], 0, False, 0
        for line, has_word in zip(lines, worded):
            if has_word:
                deleting = bool(gone[at])
                at += 1
                if deleting:
                    words += len(line.encode().split())
            if not deleting:
                out.append(line)
        return "\n".join(out), n, int(gone.sum()), words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, runs = batch.column(names.index("text")).to_pylist(), batch.column(names.index("__runs")).to_pylist()
            done = [clean(t, r) for t, r in zip(texts, runs)]
            columns = [pa.array([d[0] for d in done], pa.string()) if f.name == "text" else batch.column(names.index(f.name)) for f in kept]
            columns += [pa.array([d[i] for d in done], pa.int64()) for i in (1, 2, 3) if extra]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), *extra])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} long" for c in extra)])
    return marked.mapInArrow(lean(run), schema)
