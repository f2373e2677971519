"""A stored index of fingerprints: runs of inserted prints, replaced or removed by later runs, and merged."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import matching
from . import stage


class PrintIndex:
    """Fingerprints in a folder that all executors share, searched without being computed again.

    ``insert`` appends a run: the prints' tables and their posting lists (feature -> signal), dealt
    to folders by ``bucket`` of the feature, so that a look-up opens the buckets it asks for. A
    signal's prints are those of the last run that names it; a run may also name signals as removed.
    ``merge`` rewrites what is live as one run. A run counts from when a new manifest lists it:
    manifests are numbered and created only if they don't exist, so of two writers at a time one
    fails and readers never see part of a run. Readers keep the manifest they began with.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # files

    def _fs(self, path: str):
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        path, files = self._fs(f"{self.path}/manifests")
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def runs(self) -> list[str]:
        """The runs of the last manifest, oldest first."""
        found = self._manifests()
        if not found:
            return []
        return sorted(r["value"] for r in self.spark.read.text(f"{self.path}/manifests/{found[-1]}").collect() if r["value"])

    def _commit(self, runs: list[str], seen: int) -> None:
        path, files = self._fs(f"{self.path}/manifests/{seen:08d}")
        out = files.create(path, False)  # fails where another writer was faster
        out.write(bytearray("\n".join(runs).encode()))
        out.close()

    def _read(self, table: str, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("run").isin(runs))

    def _write(self, run: str, tables: dict[str, DataFrame]) -> None:
        for name, rows in tables.items():
            kept = rows.drop("run", "bucket")
            if name == "postings":
                kept = kept.withColumn("bucket", F.pmod("feature", F.lit(self.buckets)).cast("int")).repartition("bucket", F.pmod(F.xxhash64("signal_id"), F.lit(8)))
                kept.write.partitionBy("bucket").parquet(f"{self.path}/{name}/run={run}")
            else:
                kept.write.parquet(f"{self.path}/{name}/run={run}")

    # changes

    def insert(self, prints: matching.Fingerprints) -> None:
        """Add prints; those of signals the index has replace them whole."""
        self._append(prints, prints.meta.select("signal_id", F.lit(True).alias("live")))

    def remove(self, ids: DataFrame) -> None:
        """Take signals (signal_id) out; ones the index doesn't have are no error."""
        self._append(None, ids.select("signal_id", F.lit(False).alias("live")).distinct())

    def _append(self, prints: matching.Fingerprints | None, ids: DataFrame) -> None:
        seen, runs = len(self._manifests()), self.runs()
        run = f"r{seen:08d}-{uuid.uuid4().hex[:8]}"
        tables = {} if prints is None else prints.tables() | {"postings": matching.postings_of(prints)}
        self._write(run, {**tables, "ids": ids})
        self._commit([*runs, run], seen)

    def merge(self) -> None:
        """Rewrite the live prints as one run and delete the runs it replaces."""
        seen, runs = len(self._manifests()), self.runs()
        if len(runs) < 2:
            return
        live = self.prints()
        run = f"r{seen:08d}-{uuid.uuid4().hex[:8]}"
        self._write(run, live.tables() | {"postings": live.postings, "ids": live.meta.select("signal_id", F.lit(True).alias("live"))})
        self._commit([run], seen)
        for old in runs:
            for table in ("hashes", "landmarks", "meta", "subs", "postings", "ids"):
                path, files = self._fs(f"{self.path}/{table}/run={old}")
                files.delete(path, True)

    def drop(self) -> None:
        stage.drop(self.spark, self.path)

    # reading

    def prints(self) -> matching.Fingerprints:
        """The live prints, with their posting lists. Rows of replaced runs are left out by (signal_id, run)."""
        runs = self.runs()
        if not runs:
            raise ValueError(f"no prints in {self.path}")
        ids = self._read("ids", runs)
        last = ids.groupBy("signal_id").agg(F.max(F.struct("run", "live")).alias("last"))
        gone = ids.join(last, "signal_id").where((F.col("run") < F.col("last.run")) & F.col("live") | ((F.col("run") == F.col("last.run")) & ~F.col("last.live"))).select("signal_id", "run")
        n = gone.count() if len(runs) > 1 else 0
        gone = F.broadcast(gone) if n <= matching.BROADCAST_ROWS else gone
        live = lambda t: self._read(t, runs).join(gone, ["signal_id", "run"], "left_anti") if n else self._read(t, runs)
        return matching.Fingerprints(*[live(t).drop("run") for t in ("hashes", "landmarks", "meta", "subs")], postings=live("postings").drop("run"), buckets=self.buckets)

    def size(self) -> int:
        return self.prints().meta.count() if self.runs() else 0

    def search(self, queries: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``matching.search`` over the live prints, for queries (signal_id) that are in the index."""
        return matching.search(queries, self.prints(), threshold)

    def similar(self, queries: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``matching.similar`` over the live prints: the scores alone, without matched segments."""
        return matching.similar(queries, self.prints(), threshold)
