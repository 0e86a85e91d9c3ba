"""Keyed tables that merge on read.

A write costs what it brings: it adds one delta folder ``delta/v=<n>`` with the rows (one per
key) that batch n inserts, replaces or removes. Readers take base and deltas together, the
newest version of a key wins. Base files lie by key bucket; once ``compact_after`` deltas have
gathered, the next write folds them into new files of the buckets they touch and leaves the
other buckets' files as they are. A map (bucket -> the compaction that wrote its files) is the
last thing a compaction writes, so a reader sees either none or all of it, and a run that
failed half-way leaves nothing behind that counts.

Versions are micro-batch numbers: a retried batch overwrites its own delta. A compaction only
folds deltas older than the batch that starts it, which are committed by then, so what a retry
reads (``before``) is still there. Null keys are keys like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import VersionedTable, _Versions


def null_safe(a: DataFrame, b: DataFrame, key: list[str], how: str) -> DataFrame:
    """Left semi or anti join of ``a`` with ``b`` on ``key``, nulls being equal."""
    other = b.select(*[F.col(k).alias(f"_k_{k}") for k in key])
    return a.join(other, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in key]), how)


class MergeTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = 16, compact_after: int = 8):
        self.spark, self.path, self.key = spark, path.rstrip("/"), list(key)
        self.schema = spark.createDataFrame([], schema).schema
        self.names = [f.name for f in self.schema]
        self.buckets, self.compact_after = buckets, compact_after
        full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.schema)
        self.full = f"{full}, _v long, _gone boolean, _bucket int"
        self.deltas = _Versions(spark, f"{self.path}/delta", self.full)
        self.map = VersionedTable(spark, f"{self.path}/map", "_bucket int, g long")

    # -- writing

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, version: int, gone: DataFrame | None = None) -> None:
        """Upserts ``rows`` (one per key) as version ``version``; ``gone`` holds keys to remove."""
        if len(self._open(version)) >= self.compact_after:
            self.compact(version - 1)
        new = rows.select(*self.names).withColumn("_gone", F.lit(False))
        if gone is not None:
            dead = gone.select(*self.key).select(
                *[(F.col(n) if n in self.key else F.lit(None)).cast(self.schema[n].dataType).alias(n) for n in self.names])
            new = new.unionByName(null_safe(dead, new, self.key, "left_anti").withColumn("_gone", F.lit(True)))
        new = new.withColumn("_v", F.lit(version).cast("long")).withColumn("_bucket", self.bucket())
        self.deltas.write(new.select(*self.names, "_v", "_gone", "_bucket"), version)

    def compact(self, upto: int) -> list[int]:
        """Folds the deltas up to version ``upto`` into the base; returns the buckets rewritten."""
        versions = [v for v in self._open() if v <= upto]
        if not versions:
            return []
        recent = self._newest(versions)
        touched = sorted(r[0] for r in recent.select("_bucket").distinct().collect())     # at most ``buckets``
        old = self._map()
        merged = null_safe(self._base({b: g for b, g in old.items() if b in touched}), recent, self.key, "left_anti").unionByName(recent.where(~F.col("_gone")))
        at = f"{self.path}/base/g={versions[-1]}"
        merged.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
        there = set(self._folders(at))
        now = {b: g for b, g in old.items() if b not in touched} | {b: versions[-1] for b in touched if b in there}
        before = self._map_versions()
        self.map.write(self.spark.createDataFrame(sorted(now.items()), "_bucket int, g long"), versions[-1])
        if before:      # what the map before last needed is past every reader
            for v in [v for v in self.deltas._versions() if v <= before[-1]]:
                self._delete(f"{self.path}/delta/v={v}")
            used = set(now.values()) | set(old.values())
            for g in [g for g in self._numbers(f"{self.path}/base", "g=") if g not in used]:
                self._delete(f"{self.path}/base/g={g}")
        return touched

    # -- reading

    def read(self, before: int | None = None) -> DataFrame:
        """The table (of the versions below ``before``)."""
        return self._merged(self._map(), before).select(*self.names)

    def lookup(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """The rows of some keys; only the files of their buckets are read."""
        keys = keys.select(*self.key).distinct().withColumn("_bucket", self.bucket())
        own = {r[0] for r in keys.select("_bucket").distinct().collect()}
        rows = self._merged({b: g for b, g in self._map().items() if b in own}, before, sorted(own))
        return null_safe(rows, keys, self.key, "left_semi").select(*self.names)

    # -- parts

    def _merged(self, files: dict[int, int], before: int | None, own: list[int] | None = None) -> DataFrame:
        versions = self._open(before)
        base = self._base(files)
        if not versions:
            return base
        recent = self._newest(versions, own)
        return null_safe(base, recent, self.key, "left_anti").unionByName(recent.where(~F.col("_gone")))

    def _map_versions(self) -> list[int]:
        return self.map._versions()

    def _map(self) -> dict[int, int]:
        return {r["_bucket"]: r["g"] for r in self.map.latest().collect()}      # one row per bucket

    def _open(self, before: int | None = None) -> list[int]:
        """Versions of the deltas that no compaction has folded."""
        folded = max(self._map_versions(), default=-1)
        return [v for v in self.deltas._versions() if v > folded and (before is None or v < before)]

    def _base(self, files: dict[int, int]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], self.full)
        plain = self.full.rpartition(",")[0]
        paths = [f"{self.path}/base/g={g}/_bucket={b}" for b, g in sorted(files.items())]
        return self.spark.read.schema(plain).parquet(*paths).withColumn("_bucket", self.bucket())

    def _newest(self, versions: list[int], own: list[int] | None = None) -> DataFrame:
        """The last row of each key in some deltas."""
        rows = self.spark.read.schema(self.full).parquet(*[f"{self.path}/delta/v={v}" for v in versions])
        if own is not None:
            rows = rows.where(F.col("_bucket").isin(own))
        if len(versions) == 1:
            return rows
        rest = [c for c in rows.columns if c not in self.key and c != "_v"]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), "_v").alias("_r"), F.max("_v").alias("_v"))
        return last.select(*[F.col(c) if c in self.key or c == "_v" else F.col(f"_r.{c}").alias(c) for c in rows.columns])

    def _hadoop(self, at: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, at: str, prefix: str) -> list[int]:
        p, fs = self._hadoop(at)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return [int(n[len(prefix):]) for n in names if n.startswith(prefix)]

    def _folders(self, at: str) -> list[int]:
        return self._numbers(at, "_bucket=")

    def _delete(self, at: str) -> None:
        p, fs = self._hadoop(at)
        fs.delete(p, True)
