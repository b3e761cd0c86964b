"""A store of series on disk: appended as a whole or not at all, only touched partitions written anew (A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import THROW, TS, append_ts

BUCKETS = 64


class SeriesStore:
    """Series (TS) in Parquet, in one part for each version and bucket of names.

    A commit writes the parts that it touches to a folder of its own, data/commit=<n>, and then one small file that says of each
    part which commit holds it, manifests/commit=<n>. Readers take the latest such file, which appears by a single rename; so a
    commit that is refused, fails or is half written changes nothing, and readers see the store before or after it. Of two
    writers that begin at one commit the second finds the folder taken and fails. Parts are as many as versions times
    ``buckets``; their list goes to the driver. Folders of former commits stay until someone clears them."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.hash("name"), F.lit(self.buckets)).alias("bucket")

    def parts(self) -> tuple[int, dict[tuple[int, int], int]]:
        """(the latest commit, or -1, and the commit of each part (version, bucket))"""
        manifests = self.spark.read.schema("version int, bucket int, held_by int, commit int").option("basePath", f"{self.path}/manifests")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return -1, {}
        every = manifests.parquet(f"{self.path}/manifests")
        last = every.agg(F.max("commit")).first()[0]
        if last is None:
            return -1, {}
        return last, {(r["version"], r["bucket"]): r["held_by"] for r in every.filter(F.col("commit") == last).collect()}

    def _read(self, parts: dict[tuple[int, int], int]) -> DataFrame:
        paths = [f"{self.path}/data/commit={c}/version={v}/bucket={b}" for (v, b), c in sorted(parts.items())]
        if not paths:
            return self.spark.createDataFrame([], TS)
        rows = self.spark.read.schema(f"{TS}, commit int, bucket int").option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.select(*self.spark.createDataFrame([], TS).columns)

    def read(self) -> DataFrame:
        """All series as of the latest commit; later commits don't change what was read."""
        return self._read(self.parts()[1])

    def append(self, new: DataFrame, policy: str = THROW) -> int:
        """Adds ``new`` by a policy of ``append_ts`` and returns the number of the commit, or the latest if ``new`` is empty. Only
        parts that ``new`` has rows of are read and written."""
        commit, held = self.parts()
        touched = {(r["version"], r["bucket"]) for r in new.select("version", self._bucket()).distinct().collect()}
        if not touched:
            return commit
        columns = self.spark.createDataFrame([], TS).columns
        added = append_ts(self._read({p: c for p, c in held.items() if p in touched}), new.select(*columns), policy)
        parts = added.select(*columns, self._bucket()).repartition("version", "bucket").sortWithinPartitions("name", "point")
        parts.write.partitionBy("version", "bucket").parquet(f"{self.path}/data/commit={commit + 1}")
        now = [(v, b, commit + 1 if (v, b) in touched else c) for (v, b), c in ({p: 0 for p in touched} | held).items()]
        rows = self.spark.createDataFrame(now, "version int, bucket int, held_by int").coalesce(1)
        rows.write.parquet(f"{self.path}/manifests/commit={commit + 1}")
        return commit + 1
