"""What the operators share: intermediate tables, column hygiene, numbering."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.tables import cut, drop_table, number_within, partitions, scratch

__all__ = ["SPACE_CHARS", "SPACE_CLASS", "cut", "drop_table", "join_counted", "lean", "number_within", "partitions", "scratch"]

#: ASCII white space as the contracts define it: space and tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def _settle(keep: int) -> None:
    """Let this Python worker give freed memory back, but for ``keep`` bytes.

    Workers outlive their tasks. Arrow's own pool and glibc's growing threshold
    would keep what a task has freed, next to the executor's heap.
    """
    import pyarrow as pa

    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, max(keep, 1 << 20))  # M_MMAP_THRESHOLD: larger blocks are unmapped when freed
        libc.mallopt(-1, max(keep, 1 << 17))  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)


def lean(run, keep: int = 0):
    """``run`` for mapInArrow, tidying up before and after. ``keep``: bytes freed
    while it runs that it may use again at once, for many short-lived arrays."""

    def tidy(batches):
        _settle(keep)
        try:
            yield from run(batches)
        finally:
            _settle(0)

    return tidy


#: Keys that one of so many rows has are few enough to broadcast: at most this many.
HEAVY = 1000


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str, spread: list[str], total: int) -> DataFrame:
    """``rows`` left-joined with ``table``, which has one row per ``keys`` (longs)
    and in ``n`` how many of the ``total`` rows have them; ``n`` is left out.

    Keys of total / HEAVY rows or more are at most HEAVY keys, whatever the size,
    and are broadcast. The others are joined by a shuffle in which no key has more
    rows than that; rows of heavy keys are dealt in it by a hash of ``spread``.
    """
    values = [c for c in table.columns if c not in keys and c != n]
    is_heavy = F.col(n) * HEAVY >= total
    heavy = table.where(is_heavy).select(*(F.col(k).alias(f"__h_{k}") for k in keys), F.struct(*values).alias("__heavy"))
    light = table.where(~is_heavy).select(*(F.col(k).alias(f"__l_{k}") for k in keys), F.struct(*values).alias("__light"))
    same = lambda side: [F.col(f"__{side}_{k}") for k in keys]
    on = [F.col(k) == h for k, h in zip(keys, same("h"))]
    first = rows.join(F.broadcast(heavy), on, "left").drop(*(f"__h_{k}" for k in keys))
    dealt = first.withColumns({f"__k_{k}": F.when(F.col("__heavy").isNull(), F.col(k)).otherwise(F.xxhash64(F.lit(k), *spread)) for k in keys})
    both = dealt.join(light.hint("merge"), [F.col(f"__k_{k}") == c for k, c in zip(keys, same("l"))], "left")
    found = F.coalesce("__heavy", "__light")
    return both.select(*rows.columns, *(found[v].alias(v) for v in values))
