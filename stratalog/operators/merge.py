"""Ordered merge of runs, and compaction."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.operators.log import newest


def union_runs(runs: list[DataFrame]) -> DataFrame:
    """All entries with ``table_idx``, the place of their run in the list."""
    return reduce(DataFrame.unionByName, (r.withColumn("table_idx", F.lit(i).cast("long")) for i, r in enumerate(runs)))


def kway_merge(runs: list[DataFrame] | DataFrame, descending: bool = False) -> DataFrame:
    """Entries of all runs in key order; equal keys stay, the earlier run first."""
    rows = runs if isinstance(runs, DataFrame) else union_runs(runs)
    return rows.orderBy(F.desc("key") if descending else F.asc("key"), F.asc("table_idx"))


def dedupe(entries: DataFrame, precedence: list[Column] | None = None, within: list[str] | None = None) -> DataFrame:
    """One entry per key: the first by ``precedence`` (the newest by default)."""
    return newest(entries, [*(within or []), "key"], precedence or [F.desc("seq")])


class Strategy(Protocol):
    """Chooses which runs are merged together."""

    def choose(self, manifest: DataFrame) -> DataFrame:
        """(run_id, group_id) of the runs to merge; runs left out stay as they are."""


@dataclass(frozen=True)
class FixedFanIn:
    """Every ``fan_in`` runs, oldest first, become one; a remainder waits."""

    fan_in: int = 2

    def choose(self, manifest: DataFrame) -> DataFrame:
        # One row per run: the manifest is small by nature. A merged run is as old as
        # what it holds, not as its id.
        live = manifest.where("state = 'live'") if "state" in manifest.columns else manifest
        rank = F.row_number().over(Window.orderBy(*(["created_seq"] if "created_seq" in live.columns else []), "run_id")) - 1
        ranked = live.select("run_id", rank.alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
        full = F.floor(F.col("n") / self.fan_in) * self.fan_in
        return ranked.where(F.col("rank") < full).select("run_id", F.floor(F.col("rank") / self.fan_in).cast("long").alias("group_id"))


def compact(entries: DataFrame, groups: DataFrame | None = None, drop_tombstones: bool = False) -> DataFrame:
    """Merged contents: one entry per key (and group), the newest operation's.

    Without ``groups`` all runs are merged. Tombstones are carried along unless
    ``drop_tombstones``, which is right only where no older run is left out.
    """
    if groups is None:
        merged = dedupe(entries)
    else:
        merged = dedupe(entries.join(groups, "run_id"), within=["group_id"])
    return merged.where(~F.col("is_tombstone")) if drop_tombstones else merged


def compact_late(entries: DataFrame) -> DataFrame:
    """``compact`` for wide values: keys are merged first, and values fetched for
    the survivors only."""
    winners = dedupe(entries.select("key", "run_id", "seq", "is_tombstone")).select("run_id", "key")
    return entries.join(winners, ["run_id", "key"], "left_semi")
