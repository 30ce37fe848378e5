"""Runs as sorted Parquet folders under a manifest.

The manifest is a table of versions: ``manifest/v=<n>`` holds the complete list of
runs of version n. A change writes the next version, so readers see a merge
whole or not at all: new runs in, old ones retired. Folders of retired runs are
deleted by ``vacuum`` only. A folder without Spark's _SUCCESS was left by a writer
that died: it isn't a run (or a version), and the next write to it replaces it. One
writer at a time; readers need no lock.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.functions.layout import encoded_length
from stratalog.operators import merge
from stratalog.operators.log import run_entries

MANIFEST_COLUMNS = "run_id long, path string, n_keys long, n_tombstones long, min_key binary, max_key binary, total_bytes long, created_seq long, state string, min_seq long"


@dataclass(frozen=True)
class RunOptions:
    """How runs are written."""

    files_per_run: int = 1
    bloom_filter: bool = False
    strategy: merge.Strategy = field(default_factory=merge.FixedFanIn)
    #: Called with (ids merged, new id) after each merge that a version made live.
    on_merge: Callable[[list[int], int], None] | None = None


class RunStore:
    def __init__(self, spark: SparkSession, root: str, options: RunOptions | None = None):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options or RunOptions()

    # Manifest

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _whole(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def _clear_torn(self, path: str) -> None:
        if not self._whole(path):
            fs, p = self._fs(path)
            fs.delete(p, True)

    def version(self) -> int:
        """0: nothing written yet."""
        fs, path = self._fs(f"{self.root}/manifest")
        if not fs.exists(path):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return max((int(n[2:]) for n in names if n.startswith("v=") and self._whole(f"{self.root}/manifest/{n}")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        n = self.version() if version is None else version
        if not n:
            return self.spark.createDataFrame([], MANIFEST_COLUMNS)
        return self.spark.read.schema(MANIFEST_COLUMNS).parquet(f"{self.root}/manifest/v={n}")

    def _commit(self, manifest: DataFrame) -> int:
        n = self.version() + 1
        self._clear_torn(f"{self.root}/manifest/v={n}")
        manifest.coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/manifest/v={n}")
        return n

    def live(self) -> DataFrame:
        return self.manifest().where("state = 'live'")

    # Runs

    def path(self, run_id: int) -> str:
        """Run ids grow; no clock is asked, so names never collide."""
        return f"{self.root}/runs/run_id={run_id:020d}"

    def write_run(self, entries: DataFrame, run_id: int) -> DataFrame:
        """Write sorted, unique entries as a new run; a whole one is an error, what a
        dead writer left is replaced. Returns the run's manifest row."""
        self._clear_torn(self.path(run_id))
        n = self.options.files_per_run
        ordered = entries.select("key", "value", "is_tombstone", "seq")
        ordered = (ordered.repartitionByRange(n, "key") if n > 1 else ordered.coalesce(1)).sortWithinPartitions("key")
        writer = ordered.write.mode("errorifexists")
        if self.options.bloom_filter:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true")
        writer.parquet(self.path(run_id))
        return self._describe(run_id)

    def _describe(self, run_id: int) -> DataFrame:
        size = F.sum(encoded_length() + F.octet_length("key") + F.lit(32)) + 16
        key = F.col("key").cast("binary")
        row = self.open_run(run_id).agg(
            F.lit(run_id).cast("long").alias("run_id"), F.lit(self.path(run_id)).alias("path"), F.count(F.lit(1)).alias("n_keys"),
            F.coalesce(F.sum(F.col("is_tombstone").cast("long")), F.lit(0)).alias("n_tombstones"), F.min(key).alias("min_key"), F.max(key).alias("max_key"),
            F.coalesce(size, F.lit(16)).cast("long").alias("total_bytes"), F.coalesce(F.max("seq"), F.lit(0)).alias("created_seq"), F.lit("live").alias("state"),
            F.coalesce(F.min("seq"), F.lit(0)).alias("min_seq"),
        )
        return self.spark.createDataFrame(row.collect(), MANIFEST_COLUMNS)  # one row

    def open_run(self, run_id: int) -> DataFrame:
        return self.spark.read.parquet(self.path(run_id))

    def entries(self, manifest: DataFrame | None = None, key=None) -> DataFrame:
        """Entries of all live runs; with ``key``, of runs whose range holds it."""
        rows = manifest if manifest is not None else self.live()
        if key is not None:
            wanted = F.lit(key).cast("binary")
            rows = rows.where((F.col("min_key") <= wanted) & (F.col("max_key") >= wanted))
        ids = [r["run_id"] for r in rows.select("run_id").orderBy("run_id").collect()]  # one per run
        if not ids:
            return self.spark.createDataFrame([], "key binary, value binary, is_tombstone boolean, seq long, run_id long")
        runs = self.spark.read.option("basePath", f"{self.root}/runs").parquet(*(self.path(i) for i in ids))
        found = runs.withColumn("run_id", F.col("run_id").cast("long"))
        return found.where(F.col("key") == F.lit(key)) if key is not None else found

    def load(self) -> DataFrame:
        """Whole runs found in the folder, whatever the manifest says: (run_id, path)."""
        fs, path = self._fs(f"{self.root}/runs")
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        rows = sorted((int(p.getName()[7:]), f"{self.root}/runs/{p.getName()}") for p in found if p.getName().startswith("run_id=") and self._whole(f"{self.root}/runs/{p.getName()}"))
        return self.spark.createDataFrame(rows, "run_id long, path string")

    # Changes

    def flush(self, log: DataFrame, mode: str = "intended") -> int | None:
        """Write the open generation of ``log`` as a run; its id, or None if it
        leaves nothing."""
        entries = run_entries(log.where("run_id IS NULL"), mode)
        if entries.isEmpty():
            return None
        run_id = self._next_id()
        row = self.write_run(entries, run_id)
        self._commit(self.manifest().unionByName(row))
        return run_id

    def _next_id(self) -> int:
        return int(self.manifest().agg(F.max("run_id")).first()[0] or 0) + 1

    def register(self, run_id: int) -> int:
        """Add a written run; one that is known, live or retired, stays as it is."""
        known = self.manifest()
        if not known.where(F.col("run_id") == run_id).isEmpty():
            return self.version()
        return self._commit(known.unionByName(self._describe(run_id)))

    def retire(self, run_ids: list[int]) -> int:
        """Take runs out of reads; their files stay until ``vacuum``."""
        gone = F.col("run_id").isin(run_ids)
        return self._commit(self.manifest().withColumn("state", F.when(gone, "retired").otherwise(F.col("state"))))

    def compact(self, drop_tombstones: bool = False) -> list[int]:
        """Merge runs as the strategy says; one version swaps all of them.

        ``drop_tombstones`` drops them where nothing older is left out: every
        other live run holds only operations after the group's last one. Elsewhere
        they stay, as an older run might hold what they delete.
        """
        before = self.manifest()
        groups = self.options.strategy.choose(before).collect()  # one row per run
        merged: dict[int, list[int]] = {}
        for r in groups:
            merged.setdefault(r["group_id"], []).append(r["run_id"])
        if not merged:
            return []
        live = [(r["run_id"], r["min_seq"], r["created_seq"]) for r in before.where("state = 'live'").collect()]  # one per run
        next_id, rows, new = self._next_id(), before, []
        for group in sorted(merged):
            ids = merged[group]
            entries = self.entries(before.where(F.col("run_id").isin(ids)))
            rows = rows.withColumn("state", F.when(F.col("run_id").isin(ids), "retired").otherwise(F.col("state")))
            last = max((seq for i, _, seq in live if i in ids), default=0)
            oldest = all(first > last for i, first, _ in live if i not in ids)
            rows = rows.unionByName(self.write_run(merge.compact(entries, drop_tombstones=drop_tombstones and oldest), next_id))
            new.append(next_id)
            next_id += 1
        self._commit(rows)
        for group, made in zip(sorted(merged), new):
            if self.options.on_merge:
                self.options.on_merge(sorted(merged[group]), made)
        return new

    def vacuum(self) -> list[int]:
        """Delete the files of retired runs and forget them."""
        ids = [r["run_id"] for r in self.manifest().where("state = 'retired'").select("run_id").collect()]
        self._commit(self.manifest().where("state <> 'retired'"))
        for i in ids:
            fs, path = self._fs(self.path(i))
            fs.delete(path, True)
        return ids
