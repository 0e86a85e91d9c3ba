"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import checkpoint_dir, cut_lineage, prepare
from ..sources.tables import table

# Rows per Arrow batch: documents reach 10^5 characters, so 400 rows stay at a few MB.
BATCH_ROWS = 400


def ready(spark: SparkSession) -> None:
    """Session settings of the operators: the package on the workers, Arrow batches sized for
    long texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, in a session made ready."""
    ready(spark)
    return table(spark, sf_dir, name)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for large intermediate results, which
    a checkpoint would hold uncompressed."""
    at = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, folder: str) -> None:
    """Removes a folder of staged tables once nothing reads them any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for the actions inside (few rows that are large)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema) -> DataFrame:
    """``fn`` over every Arrow batch of ``df`` (``None``: no rows for this batch)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out = fn(b) if b.num_rows else None
            if out is not None and out.num_rows:
                yield out
    return df.mapInArrow(run, schema)


def extended(schema: StructType, **columns: str) -> StructType:
    """``schema`` (left as it is) and further columns."""
    out = StructType(list(schema.fields))
    for name, kind in columns.items():
        out = out.add(name, kind)
    return out


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, lengthened until they clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's strings as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [x if x is not None else b"" for x in col.to_pylist()]


def fingerprint_col(c: str):
    """uint64 kept in a long column -> 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(F.col(c))), 16, "0")


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of uint64 numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the links a[i]-b[i]."""
    lab = np.arange(n)
    while True:
        la, lb = lab[a], lab[b]
        apart = la != lb
        if not apart.any():
            return lab
        np.minimum.at(lab, np.maximum(la[apart], lb[apart]), np.minimum(la[apart], lb[apart]))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node in ``links``; root is the smallest node reachable.

    Alternating large-star / small-star rounds over the link table: a link joins two
    nodes, each round hangs neighbours under the smallest one seen, and the rounds end
    when no link changes. Every round is a partial aggregate plus an equi-join and ends in a
    reliable checkpoint; the aggregate is checkpointed first, so the join is a plain one,
    which AQE splits for a hub with very many links.
    Self-links and nulls are ignored; an empty table gives an empty result."""
    def clean(df):
        hi, lo = F.greatest("a", "b"), F.least("a", "b")
        return df.where(F.col("a") != F.col("b")).select(hi.alias("a"), lo.alias("b")).distinct()

    edges = cut_lineage(clean(links.select(F.col(a).alias("a"), F.col(b).alias("b"))))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = clean(both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = cut_lineage(large)
        low = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        edges = cut_lineage(clean(
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b")))))
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1000003)).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = edges.groupBy("a").agg(F.min("b").alias("root"))
    return (roots.select(F.col("a").alias("node"), "root")
            .unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))
