"""Which of a micro-batch's keys are known already (R2, D5): an index of 16-byte digests.

Batch n adds one segment per key bucket: a Parquet file of the digests and, in a table of its
own, a Bloom filter of them. A lookup tests the batch's digests against the filters of their
buckets and reads only the segments that a filter can't exclude; the digests there are then
compared, so the answer is exact and a false positive only costs the reading of one segment.
A segment holds a part of one batch, never of the table, so the rows that a lookup reads
follow the batch and its repeats. Filters (``BITS`` per key) are read in place of the keys.

Versions are micro-batch numbers: a retried batch overwrites its own segments, and lookups
take the versions below the batch's own. Null digests are no keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import _Versions

BITS = 16          # of the filter, per key: about 5 false positives in 10,000
HASHES = 7


def _places(keys: pa.Array, size: int) -> np.ndarray:
    """The bits of each 16-byte key in a filter of ``size`` bits (keys x HASHES)."""
    halves = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)
    step = (halves[:, 1] | np.uint64(1))[:, None]
    return ((halves[:, :1] + np.arange(HASHES, dtype=np.uint64) * step) % np.uint64(size)).astype(np.int64)


def make_filter(keys: pa.Array, bits: int = BITS) -> bytes:
    mask = np.zeros(-(-max(8, bits * len(keys)) // 8) * 8, bool)
    mask[_places(keys, len(mask)).ravel()] = True
    return np.packbits(mask).tobytes()


def may_hold(filter_: bytes, keys: pa.Array) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(filter_, np.uint8)).astype(bool)
    return bits[_places(keys, len(bits))].all(axis=1)


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, bits: int = BITS):
        self.spark, self.path, self.buckets, self.bits = spark, path.rstrip("/"), buckets, bits
        self.keys = _Versions(spark, f"{self.path}/keys", "key binary")
        self.filters = _Versions(spark, f"{self.path}/filters", "bucket int, version long, filter binary")

    def _bucketed(self, keys: DataFrame) -> DataFrame:
        """key, bucket: the distinct digests of a one-column frame."""
        k = keys.toDF("key").where("key IS NOT NULL").distinct()
        return k.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int"))

    def add(self, keys: DataFrame, version: int) -> None:
        """Adds a frame of digests (one column) as version ``version``."""
        bits = self.bits

        def build(t: pa.Table) -> pa.Table:
            key = t["key"].combine_chunks()
            return pa.table({"bucket": t["bucket"][:1], "version": pa.array([version], pa.int64()), "filter": [make_filter(key, bits)]})
        k = self._bucketed(keys)
        k.repartition(self.buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/keys/v={version}")
        own = self.spark.read.schema("key binary, bucket int").parquet(f"{self.path}/keys/v={version}")
        self.filters.write(own.groupBy("bucket").applyInArrow(build, self.filters.schema), version)

    def candidates(self, keys: DataFrame, before: int | None = None) -> list[tuple[int, int]]:
        """(version, bucket) of the segments that may hold any of the digests."""
        versions = [v for v in self.filters._versions() if before is None or v < before]
        if not versions:
            return []
        filters = self.spark.read.schema(self.filters.schema).parquet(*[f"{self.path}/filters/v={v}" for v in versions])

        def test(asked: pa.Table, held: pa.Table) -> pa.Table:
            if not asked.num_rows or not held.num_rows:
                return pa.table({"version": pa.array([], pa.int64()), "bucket": pa.array([], pa.int32())})
            key = asked["key"].combine_chunks()
            hit = [bool(may_hold(f, key).any()) for f in held["filter"].to_pylist()]
            return held.select(["version", "bucket"]).filter(pa.array(hit))
        found = self._bucketed(keys).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(test, "version long, bucket int")
        return sorted((r["version"], r["bucket"]) for r in found.collect())      # pairs of numbers, at most one per segment

    def segments(self, pairs: list[tuple[int, int]]) -> DataFrame:
        if not pairs:
            return self.spark.createDataFrame([], "key binary")
        return self.spark.read.schema("key binary").parquet(*[f"{self.path}/keys/v={v}/bucket={b}" for v, b in pairs])

    def known(self, keys: DataFrame, before: int | None = None) -> DataFrame:
        """key: those of the digests that a version below ``before`` holds."""
        held = self.segments(self.candidates(keys, before)).distinct()
        return keys.toDF("key").where("key IS NOT NULL").distinct().join(held, "key", "left_semi")
