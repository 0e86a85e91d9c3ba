"""Session construction and lineage helpers.

Every operator in the package is a pure ``DataFrame -> DataFrame`` transform; this
module holds the only pieces that touch session state: building a session for
tests/bench, pinning the session time zone, and cutting lineage of iterative plans.
"""

from __future__ import annotations

import os
import tempfile
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "feedlens",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench. On a cluster the caller's session is used."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("FEEDLENS_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings every operator relies on (idempotent, runtime-settable only)
    and make the package importable in the Python workers."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package as a zip to the context (``addPyFile``) once per context, so
    functions of the package pickled into Python workers (model slots, matrix
    summarizers) import on every executor, wherever the driver was started."""
    import zipfile
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="feedlens-py-"), "feedlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.join("feedlens", os.path.relpath(full, root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when nothing is configured *and* the master is local (tests, bench) do we
    create a scratch folder; on a cluster a machine-local folder would not survive
    executor loss, so we refuse instead.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for iterative jobs")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="feedlens-ckpt-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


# Fixed "now" used by tests and the registered queries so results are reproducible.
DEFAULT_AS_OF = datetime(2024, 2, 1, 0, 0, 0)


def ts_lit(dt: datetime):
    """A UTC timestamp literal that does not depend on the Python process time zone."""
    from pyspark.sql import functions as F
    return F.to_timestamp(F.lit(dt.strftime("%Y-%m-%d %H:%M:%S.%f")))


def cluster_conf(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Starting settings for a large cluster run, sized from the input volume.

    Shuffle partitions target ~256 MB each (AQE coalesces small ones and splits skewed
    ones at run time); scans use 256 MB splits for the text-heavy tables; the
    broadcast threshold stays at the default so only measured-small sides broadcast.
    """
    parts = max(total_cores * 2, int(input_bytes // (256 * 1024 * 1024)) + 1)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.files.maxPartitionBytes": str(256 * 1024 * 1024),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints of finished steps go when their DataFrames do
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
