"""Mixing sources to target weights by Pfair scheduling.

Each source is cut, in document order, into blocks of BLOCK_SIZE characters (a
document belongs to the block it begins in). With integer weights a_s summing to
D, block j (from 1) of source s is released at slot floor((j - 1) D / a_s) and
due at ceil(j D / a_s); each slot goes to the released block due first. Then at
any slot t a source has been given less than one block more or less than its
a_s t / D. After D slots every source has exactly a_s blocks, so the schedule
repeats: one period is simulated and every block's slot follows from it by
arithmetic, however many blocks there are. Weights are RESOLUTION parts, or as many
as the least target needs, so that one in a million is not rounded up to one in a
thousand; periods add up to SLOTS slots at most, so with n sources a target below
n / SLOTS is taken as that.

When a source has no block left a new phase begins: the weights of the others
are scaled to sum to one. So every document is kept, once, and within each phase
the deviation stays below one block.

Sources with a share of OWN_SHARE or more (1 / OWN_SHARE at most) are scheduled like
this, beside one unit that stands for all others together. The rule is the same for
any number of sources. The unit's blocks are dealt to the others' octaves by the same
schedule: an octave holds the sources whose share is at least 2 ** -k and below twice
that (one octave all below 1 / SLOTS). Within it blocks are ordered by ranges on
(j - 1/2) / weight, the middle of block j's window. But for the lowest octave, a weight is
below twice its octave's mean, so as long as the others last, a source is within three
blocks of its part of its octave and within five of its target.

The driver holds one row per own source and per octave, and the periods, at most
one per row; what is broadcast is at most (1 / OWN_SHARE) ** 2 rows with SLOTS
numbers. Places within a source are numbered by
ranges (see base.number_within), so a source with any share of the rows spreads
over many tasks.

Defined results: a null source is a source of its own; a null doc_id comes first
in its source; rows that share doc_id and source move together; a null or empty
text has size 0 and stays in its place; an empty table gives an empty table;
other columns pass through ``mix`` untouched.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalog.llm.base import cut, number_within, partitions

BLOCK_SIZE = 65_536
RESOLUTION, SLOTS = 1_000, 4_000_000
#: No limit: more sources than this had a method of their own, now all have one.
MAX_SOURCES = 1_000
OWN_SHARE = 0.01
#: Default targets: a source's share of characters to this power.
FLATTEN = 0.5


def quantised(shares: dict, resolution: int = 0) -> dict:
    """Positive integers in proportion to ``shares``, by largest remainders; their
    sum is ``resolution`` (0: what the least share needs)."""
    total = sum(shares.values())
    if not resolution:
        least = min((v for v in shares.values() if v > 0), default=1)
        resolution = max(RESOLUTION, min(-int(-total // least), SLOTS // max(1, len(shares))))
    exact = {k: (v / total if total else 1 / len(shares)) * resolution for k, v in shares.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    by_rest = sorted(exact, key=lambda k: (-(exact[k] - int(exact[k])), str(k)))
    for k in by_rest[: max(0, resolution - sum(out.values()))]:
        out[k] += 1
    return out


def period(weights: dict) -> dict:
    """Slots of each source's blocks within one period of sum(weights) slots."""
    whole = sum(weights.values())
    slots: dict = {k: [] for k in weights}
    order = {k: i for i, k in enumerate(sorted(weights, key=str))}
    waiting = [(0, order[k], k) for k in weights]  # by release
    ready: list = []  # by deadline
    heapq.heapify(waiting)
    for slot in range(whole):
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[k]) + 1) * whole // weights[k]), i, k))
        due, i, k = heapq.heappop(ready)
        assert slot < due
        slots[k].append(slot)
        heapq.heappush(waiting, (len(slots[k]) * whole // weights[k], i, k))
    return slots


@dataclass(frozen=True)
class Phase:
    number: int
    start: int  # its first slot
    length: int  # of its period
    slots: dict  # source -> slots within the period
    first: dict  # source -> the first block it takes
    blocks: dict  # source -> how many blocks


def phases(weights: dict, blocks: dict) -> list[Phase]:
    """Phases until every source's blocks are scheduled."""
    left, first, start, out = {k: n for k, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        active = {k: weights[k] for k in left}
        slots, length = period(active), sum(active.values())
        end = min((n - 1) // active[k] * length + slots[k][(n - 1) % active[k]] + 1 for k, n in left.items())
        done = {k: end // length * active[k] + sum(s < end % length for s in slots[k]) for k in left}
        out.append(Phase(len(out), start, length, slots, {k: first[k] for k in left}, done))
        start += end
        for k, n in done.items():
            first[k] += n
            left[k] -= n
        left = {k: n for k, n in left.items() if n}
    return out


def schedule(docs: DataFrame, weights: dict | None = None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """doc_id, source, size, block, phase, slot, place: order by (slot, place).

    ``weights``: target weight of each source (None: share ** FLATTEN); a source
    it doesn't name gets the smallest of them.
    """
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    # Sizes of rows that move together; only keys and sizes from here on.
    units = docs.select("doc_id", "source", size.alias("size")).groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    numbered = number_within(units, ["source"], ["doc_id"], "place", keep_part=True)
    ahead = Window.partitionBy("source", "__part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    inside = numbered.withColumn("__in", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    sums = numbered.groupBy("source", "__part").agg(F.sum("size").alias("__sum"))
    before = Window.partitionBy("source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__s"), F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    begun = inside.join(sums, inside["source"].eqNullSafe(sums["__s"]) & (inside["__part"] == sums["__p"]))
    begun = cut(begun.select("doc_id", "source", "size", "place", F.expr(f"(__before + __in) div {block_size}").alias("block")))

    begun, targets, blocks = _units(begun, weights)
    done = _slotted(begun, "__unit", "__at", targets, blocks)
    return done.select("doc_id", "source", "size", "block", "phase", "slot", "place")


def _slotted(rows: DataFrame, unit: str, at: str, targets: dict, blocks: dict) -> DataFrame:
    """Add phase and slot of block number ``at`` of each row's ``unit``."""
    plan = [(k, p.number, p.first[k], p.first[k] + n, targets[k], p.length, p.start, p.slots[k]) for p in phases(targets, blocks) for k, n in p.blocks.items()]
    schema = "__s string, phase int, __first long, __end long, __weight long, __length long, __start long, __slots array<int>"
    # A row for each unit and phase; their arrays sum to a period a phase.
    table = F.broadcast(rows.sparkSession.createDataFrame(plan, schema))
    here = (rows[unit] == table["__s"]) & (rows[at] >= table["__first"]) & (rows[at] < table["__end"])
    nth = F.col(at) - F.col("__first")
    slot = F.col("__start") + F.expr(f"({at} - __first) div __weight") * F.col("__length") + F.get("__slots", (nth % F.col("__weight")).cast("int"))
    return rows.join(table, here).select(*rows.columns, "phase", slot.cast("long").alias("slot"))


def _units(begun: DataFrame, weights: dict | None) -> tuple[DataFrame, dict, dict]:
    """begun with __unit (an own source's number, or 'rest') and __at (the block's
    place in the unit), each unit's weight and its number of blocks."""
    spark = begun.sparkSession
    per = begun.groupBy("source").agg(F.sum("size").alias("size"), (F.max("block") + 1).alias("blocks"))
    if weights is None:
        per = per.withColumn("weight", F.pow(F.col("size").cast("double"), F.lit(FLATTEN)))
    else:
        given = spark.createDataFrame([(k, float(w)) for k, w in weights.items()], "__w string, weight double")
        per = per.join(given, per["source"].eqNullSafe(given["__w"]), "left").fillna(float(min(weights.values(), default=1)), ["weight"])
    per = cut(per.select("source", "blocks", "weight"))
    # Sums of decimals don't depend on the order of the rows.
    top = per.agg(F.max("weight")).first()[0] or 1.0
    part = F.sum((F.col("weight") / F.lit(top)).cast("decimal(28,18)"))
    share = F.col("weight") / F.lit(top) / F.lit(float(per.agg(part).first()[0] or 1))
    is_own = share >= OWN_SHARE
    own = sorted(per.where(is_own).collect(), key=lambda r: (str(r["source"]), r["source"] is not None))
    names = {r["source"]: f"{i:03d}" for i, r in enumerate(own)}
    shares, blocks = {names[r["source"]]: r["weight"] for r in own}, {names[r["source"]]: r["blocks"] for r in own}
    units = F.broadcast(spark.createDataFrame(list(names.items()), "__s string, __unit string"))
    alone = begun.join(units, begun["source"].eqNullSafe(units["__s"])).select(begun["*"], "__unit", F.col("block").alias("__at"))

    # A share of 0 has no logarithm and is in the lowest octave.
    octave = F.greatest(F.floor(F.log2(share)), F.lit(-SLOTS.bit_length()).cast("long"))
    rest = per.where(~is_own).select("source", "blocks", "weight", F.lpad((-octave).cast("string"), 2, "0").alias("__octave"))
    octaves = {r["__octave"]: r for r in rest.groupBy("__octave").agg(F.sum("blocks").alias("blocks"), part.alias("part")).collect()}
    if not octaves:
        return alone, quantised(shares), blocks
    inner = {k: float(r["part"]) * top for k, r in sorted(octaves.items())}
    shares["rest"], blocks["rest"] = sum(inner.values()), sum(r["blocks"] for r in octaves.values())
    each = rest.select("source", "__octave", F.greatest("weight", F.lit(1e-9)).alias("weight"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    each = each.select("source", "__octave", "block", ((F.col("block") + 0.5) / F.col("weight")).alias("middle"))
    placed = _slotted(number_within(each, ["__octave"], ["middle", "source", "block"], "__nth"), "__octave", "__nth", quantised(inner), {k: r["blocks"] for k, r in octaves.items()})
    placed = placed.select(F.col("source").alias("__s"), F.col("block").alias("__b"), F.col("slot").alias("__at"))
    others = begun.join(units, begun["source"].eqNullSafe(units["__s"]), "left_anti")
    others = others.join(placed, others["source"].eqNullSafe(placed["__s"]) & (others["block"] == placed["__b"]))
    return alone.unionByName(others.select(*begun.columns, F.lit("rest").alias("__unit"), "__at")), quantised(shares), blocks


def mix(docs: DataFrame, weights: dict | None = None, block_size: int = BLOCK_SIZE) -> DataFrame:
    """All rows and columns of ``docs``, dealt to partitions and sorted in the
    mixed order: the files written from it, in order, are the mixture."""
    plan = schedule(docs, weights, block_size).select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), "slot", "place")
    plan = plan.withColumnsRenamed({"slot": "__slot", "place": "__place"})
    mixed = docs.join(plan, docs["doc_id"].eqNullSafe(plan["__d"]) & docs["source"].eqNullSafe(plan["__s"]))
    order = ["__slot", "__s", "__place"]
    return mixed.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select(*(docs[f"`{c}`"] for c in docs.columns))
