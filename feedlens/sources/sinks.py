"""Table sinks (S10, U8): tables as parquet folders ``v=<n>``, complete with ``_SUCCESS``.

* ``VersionedTable``: every write is a whole version, readers take the newest; for snapshots
  that are replaced or cleared. Tables that change row by row are ``merge.MergeTable``.
* ``AppendTable``: version n holds the rows that batch n adds.
* ``DayTable``: the same by day; whole days go without a rewrite.

A failed or retried write never exposes a half-written table, and writing the same version
twice (a retried micro-batch) is idempotent.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ts_lit


class _Versions:
    """Folders v=0,1,2,... of one table; complete ones hold ``_SUCCESS``."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        p, fs = self._fs()
        if not fs.exists(p):
            return []
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: N806
        names = [st.getPath() for st in fs.listStatus(p)]
        return sorted(int(n.getName()[2:]) for n in names
                      if n.getName().startswith("v=") and fs.exists(Path(n, "_SUCCESS")))

    def write(self, df: DataFrame, version: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")


class AppendTable(_Versions):
    """A parquet table that only grows: version n holds the rows added by batch n."""

    def read(self, before: int | None = None) -> DataFrame:
        vs = [f"{self.path}/v={v}" for v in self._versions() if before is None or v < before]
        return self.spark.read.schema(self.schema).parquet(*vs) if vs else self.spark.createDataFrame([], self.schema)

    def append(self, df: DataFrame, version: int) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        self.write(df.select(*names), version)


class DayTable(_Versions):
    """A parquet table of rows with a time (``at``), in day folders: version n holds the rows
    added by batch n. ``expire`` removes the folders of the days before a time and remembers
    it; readers cut the day that it falls into. Rows without a time never expire."""

    def __init__(self, spark: SparkSession, path: str, schema: str, at: str = "published_at"):
        super().__init__(spark, path, schema)
        self.at = at
        self.cutoffs = VersionedTable(spark, f"{self.path}-cutoff", "cutoff timestamp")

    def append(self, df: DataFrame, version: int) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        day = F.date_format(self.at, "yyyy-MM-dd")
        df.select(*names, day.alias("_day")).write.mode("overwrite").partitionBy("_day").parquet(f"{self.path}/v={version}")

    def expire(self, before: datetime, version: int) -> None:
        self.cutoffs.write(self.spark.range(1).select(ts_lit(before).alias("cutoff")), version)
        first = before.strftime("%Y-%m-%d")
        path, fs = self._fs()
        Path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path  # noqa: N806
        for s in fs.globStatus(Path(path, "v=*/_day=????-??-??")) or []:
            if s.getPath().getName()[5:] < first:
                fs.delete(s.getPath(), True)

    def read(self, before: int | None = None) -> DataFrame:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        vs = [f"{self.path}/v={v}" for v in self._versions() if before is None or v < before]
        rows = (self.spark.read.schema(f"{self.schema}, _day string").option("basePath", self.path).parquet(*vs).select(*names)
                if vs else self.spark.createDataFrame([], self.schema))
        cut = self.cutoffs.latest().first()
        return rows if cut is None else rows.where(F.col(self.at).isNull() | (F.col(self.at) >= ts_lit(cut[0])))


class VersionedTable(_Versions):
    """A parquet table kept as versions; readers take the newest. ``keep`` versions stay (the
    newest ones; at least two, as a retried batch starts from the one before)."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keep: int = 3):
        super().__init__(spark, path, schema)
        self.keep = max(2, keep)

    def latest(self, before: int | None = None) -> DataFrame:
        vs = [v for v in self._versions() if before is None or v < before]
        if not vs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={vs[-1]}")

    def write(self, df: DataFrame, version: int) -> None:
        super().write(df, version)
        for old in self._versions()[:-self.keep]:
            p, fs = self._fs()
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, f"v={old}"), True)

    def append_version(self, df: DataFrame) -> int:
        """Write ``df`` as the next version; returns the version number."""
        vs = self._versions()
        n = (vs[-1] + 1) if vs else 0
        self.write(df, n)
        return n

    def clear(self) -> int:
        """U8: an empty version (the table reads as empty; history stays)."""
        return self.append_version(self.spark.createDataFrame([], self.schema))
