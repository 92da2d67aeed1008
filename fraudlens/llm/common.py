"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.session import ensure_checkpoint_dir

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows in one Arrow batch; texts can be long, and a batch is held whole by a Python worker.
BATCH_ROWS = 256
#: Hashed before a row's values, it makes another hash of them.
_SECOND_HASH = 0x5EED


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Cap the rows of one Arrow batch, so that a Python worker never holds
    thousands of long texts. An already smaller session value stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, deleted when the driver's
    JVM ends. The folder is reachable from all executors."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it: what is
    computed twice from it is the same both times, and a lost executor costs
    a re-read, not a recomputation."""
    path = f"{shared_folder(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_hash(columns: list[str]) -> Column:
    """128-bit hash (two independent 64-bit ones) of the named columns, nulls and their positions included: it stands
    for the row, which 64 bits cannot do over 10^9 rows."""
    values = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return F.struct(F.xxhash64(*values).alias("a"), F.xxhash64(F.lit(_SECOND_HASH), *values).alias("b"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
