"""Stored state: a table in buckets of its key, changed by new versions of the buckets that a change touches.

A version is a small table of (bucket, the version that wrote it); it is written last, so a change
that breaks off half way leaves the versions before it as they were, and is simply made again.
Readers keep the version that they have begun with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.plans.storage import through_files

BUCKETS = 64


class StateTable:
    """A table with one row a key, under ``folder`` in a store that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema, buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        files, path = self._files(f"{self.folder}/versions")
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        done = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def _parts(self, version: int | None) -> dict[int, int]:
        if version is None:
            return {}
        return {r.bucket: r.version for r in self.spark.read.parquet(f"{self.folder}/versions/{version}").collect()}

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table at a version, the latest without one; of some buckets only, if asked."""
        parts = self._parts(self.latest() if version is None else version)
        paths = [f"{self.folder}/data/{n}/bucket={b}" for b, n in sorted(parts.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def commit(self, after: DataFrame) -> int:
        """Makes ``after`` the next version: only buckets with a row that is new, changed or gone are written. Returns its number."""
        before = self.latest()
        after = through_files(after.select(*self.schema.names))
        digest = lambda df: df.select(self.key, F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in self.schema.names]))).alias("h"))
        old, new = digest(self.read(before)).alias("o"), digest(after).alias("n")
        joined = old.join(new, F.col(f"o.{self.key}") == F.col(f"n.{self.key}"), "full").filter(~F.col("o.h").eqNullSafe(F.col("n.h")))
        touched = [r[0] for r in joined.select(F.coalesce(f"o.{self.key}", f"n.{self.key}").alias(self.key)).select(self.bucket()).distinct().collect()]
        number = 0 if before is None else before + 1
        rows = after.withColumn("bucket", self.bucket()).filter(F.col("bucket").isin(touched) if touched else F.lit(False))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/{number}")
        files, _ = self._files(self.folder)
        exists = lambda b: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data/{number}/bucket={b}"))
        parts = {b: n for b, n in self._parts(before).items() if b not in touched} | {b: number for b in touched if exists(b)}
        table = self.spark.createDataFrame(list(parts.items()), "bucket int, version int")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{number}")
        return number

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what only versions older than the last ``keep`` read."""
        every = self.versions()
        kept = {(b, n) for v in every[-keep:] for b, n in self._parts(v).items()}
        gone = {(b, n) for v in every[:-keep] for b, n in self._parts(v).items()} - kept
        paths = [f"{self.folder}/data/{n}/bucket={b}" for b, n in gone] + [f"{self.folder}/versions/{v}" for v in every[:-keep]]
        for p in paths:
            files, path = self._files(p)
            files.delete(path, True)
