"""A versioned store of records: an appended log in hash buckets, with compaction and point look-up.

Layout below a path: ``log/version=N/bucket=B`` and ``base/version=N/bucket=B``, Parquet, sorted
by key in each file. A key's bucket follows from its hash, so an append writes at most
``buckets`` files however many keys it holds, and a look-up opens one bucket's files alone. An append
of a version replaces that version: writing it again changes nothing. Compaction writes
the view as a base; readers take the newest base that is complete and the log above it. What
lies below is deleted by ``vacuum``, not by compaction, as readers may still be at it.

Defined results
- several rows of a key in one version: the greatest, by its columns
- a null key: left out; a deleted key (``deleted`` true): absent from the view until it is written again
- a version whose write did not end: absent; no store at the path: empty
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


@dataclass(frozen=True)
class Store:
    """Where the records of ``schema`` (DDL, with the key among its columns) lie."""

    spark: SparkSession
    path: str
    schema: str
    key: str = "project"
    buckets: int = BUCKETS

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _fs(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self, kind: str = "log") -> list[int]:
        """The complete versions of the log, or of the bases, ascending."""
        fs, folder = self._fs(), self._path(kind)
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        found = [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]
        return sorted(v for v in found if fs.exists(self._path(kind, f"version={v}", "_SUCCESS")))

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        # a bucket is one task's and a task has one bucket, so it is one file; a sort lets column statistics prune within it
        placed = rows.withColumn("bucket", self._bucket(F.col(self.key)))
        sorted_ = placed.repartitionById(self.buckets, F.col("bucket")).sortWithinPartitions("bucket", self.key)
        sorted_.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.path}/{kind}/version={version}")

    def append(self, rows: DataFrame, version: int, deleted: Column | None = None) -> None:
        """Write ``rows`` as a version of the log, in place of what that version held."""
        names = [f.name for f in self._fields()]
        own = rows.where(F.col(self.key).isNotNull()).withColumn("deleted", F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False)))
        rest = [*[n for n in names if n != self.key], "deleted"]
        one = own.groupBy(self.key).agg(F.max(F.struct(*rest)).alias("_r")).select(self.key, "_r.*")
        self._write(one.select(*names, F.lit(version).cast("long").alias("version"), "deleted"), "log", version)

    def _fields(self) -> list:
        return self.spark.createDataFrame([], self.schema).schema.fields

    def _parts(self, bucket: int | None) -> list[tuple[str, int]]:
        bases = self.versions("base")
        base = bases[-1] if bases else None
        parts = [("base", base)] if base is not None else []
        parts += [("log", v) for v in self.versions() if base is None or v > base]
        if bucket is None:
            return parts
        fs = self._fs()
        return [(k, v) for k, v in parts if fs.exists(self._path(k, f"version={v}", f"bucket={bucket}"))]

    def _read(self, bucket: int | None = None) -> DataFrame:
        own = "" if bucket is None else f"/bucket={bucket}"
        paths = [f"{self.path}/{kind}/version={v}{own}" for kind, v in self._parts(bucket)]
        stored = f"{self.schema}, version long, deleted boolean"
        if not paths:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).option("recursiveFileLookup", "true").parquet(*paths)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "version")]
        one = rows.groupBy(self.key).agg(F.max(F.struct("version", *rest)).alias("_r")).select(self.key, "_r.*")
        return one.select(*[f.name for f in self._fields()], "version", "deleted")

    def view(self, at: int | None = None) -> DataFrame:
        """The newest row of every key, with its version; ``at``: as of that version, while its log is there."""
        rows = self._read()
        if at is not None:
            bases = self.versions("base")
            if bases and bases[-1] > at:
                raise ValueError(f"version {at} lies below the base of version {bases[-1]}")
            rows = rows.where(F.col("version") <= at)
        return self._newest(rows).where("NOT deleted").drop("deleted")

    def compact(self) -> int | None:
        """Write the view as a base; its version, or None where there is nothing new."""
        logs, bases = self.versions(), self.versions("base")
        if not logs or bases and bases[-1] >= logs[-1]:
            return None
        self._write(self._newest(self._read()).where("NOT deleted"), "base", logs[-1])  # rows keep their own versions
        return logs[-1]

    def vacuum(self) -> int:
        """Delete bases and log versions that the newest base replaces; how many went."""
        bases, fs, gone = self.versions("base"), self._fs(), 0
        for kind, versions in (("base", bases[:-1]), ("log", [v for v in self.versions() if bases and v <= bases[-1]])):
            for v in versions:
                gone += fs.delete(self._path(kind, f"version={v}"), True)
        return gone

    def bucket_of(self, key: str) -> int:
        return self.spark.range(1).select(self._bucket(F.lit(key))).first()[0]

    def lookup(self, key: str) -> DataFrame:
        """The row of one key; only its bucket's files are opened, and in them row groups whose statistics allow it."""
        rows = self._read(self.bucket_of(key)).where(F.col(self.key) == key)
        return self._newest(rows).where("NOT deleted").drop("deleted")
