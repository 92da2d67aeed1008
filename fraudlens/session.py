"""SparkSession construction and cluster-safe helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType

# Settings every job relies on: UTC wall clock (oracle parity), AQE for runtime
# re-planning (coalescing, skew-join splitting, broadcast switch), no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "fraudlens",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be provided (a shared, reliable file system).
    Only a local-mode session without the setting (tests, laptops) gets a
    private scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - e.g. a Spark Connect session: no SparkContext
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured:
            return configured
        if not str(spark.conf.get("spark.master", "")).startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="fraudlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
        return path
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="fraudlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def shared_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base.replace("file:", "", 1) if base.startswith("file:") else base, name)


def session_key(spark: SparkSession) -> str:
    """Identity of the running application (unlike ``id(spark)``, never reused
    by a later session in the same process)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - sessions without a SparkContext
        return f"session-{id(spark)}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared checkpoint directory, deleted when
    the driver's JVM ends."""
    path = shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


# Spark reads a row group of binary values at once (up to 4,096 rows of any length), so tables of large ones get small groups.
PACKED_OPTIONS = {"parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1",
                  "parquet.page.size.row.check.min": "1", "parquet.block.row.count.limit": "256"}


def written_once(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and return a scan of it:
    it is computed once, holds no executor memory, and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"static/{name}")
    packed = any(isinstance(f.dataType, BinaryType) for f in df.schema.fields)
    df.write.options(**(PACKED_OPTIONS if packed else {})).mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def files_identity(spark: SparkSession, *paths: str) -> tuple:
    """Names, lengths and change times of the files of the given tables: a new
    value means the tables have changed."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for f in path.getFileSystem(conf).listStatus(path):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))
