"""A scored stream in the prediction journal: every transaction once, with the client's running count.

``foreachBatch`` gives a micro-batch again after a crash between its write and its commit. All that a batch writes stands in
folders named by the stream (its checkpoint's id) and the batch, and is replaced when it comes again; all that it reads
of the stream's state was written by earlier batches. So a repeated batch writes what it wrote.

* *Replays.* The ledger holds, per day of transactions, the ids in the journal and a Bloom filter of them, as
  table rows (day, block, four words of bits). A batch keeps one row an id (partial aggregation: a hot id costs one row a
  task), probes the filters of its rows' blocks, and only possible hits meet the ids of their days. Replays of any age
  are found; a filter's false hit costs a join row, not a result.
* *Running counts.* A transaction's count is the client's history plus the stream's earlier rows of the client: those
  of earlier batches, kept as a table of counts (differences, and a snapshot every SNAPSHOT batches), and those before it in
  the batch by time and id. The batch is range-partitioned by (client, time, id), so a hot client's rows stand in several
  partitions, which are numbered separately and offset by the counts of the partitions before.

Transactions without an id cannot be recognised and are all kept; without a client their count is the default.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudlens.operators.journal import scoring_run
from fraudlens.session import scratch_path
from fraudlens.sources.files import append_journal, path_exists

#: Blocks of 256 bits in a day's filter (a million bits: one false hit in a hundred at 100,000 ids a day).
BLOOM_BLOCKS = 4096
WORDS = 4
SNAPSHOT = 20
#: Transactions without a time.
NO_DAY = "1000-01-01"


class Scratch:
    """Tables of one micro-batch, deleted with it."""

    def __init__(self, spark: SparkSession):
        self._spark, self._folder, self._n = spark, scratch_path(spark, "batch"), 0

    def once(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self._folder}/{self._n}"
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self._spark._jvm.org.apache.hadoop.fs.Path(self._folder)
        path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The query's id: the same after every restart from its checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


# ---- replays --------------------------------------------------------------------------------------------------

def _block(id_col: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(blocks)).cast("int")


def _mask(id_col: Column, word: int) -> Column:
    """Two bits of a word, from another hash than the block's."""
    h = F.xxhash64(F.lit(1), id_col)

    def bit(shift: int) -> Column:
        at = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return bit(12 * word).bitwiseOR(bit(12 * word + 6))


def day_of(ts: Column) -> Column:
    return F.coalesce(F.to_date(ts), F.lit(NO_DAY).cast("date"))


def bloom_rows(ids: DataFrame, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """(day, block, w0..w3): the filters of a table (day, operation_id)."""
    keyed = ids.select("day", _block(F.col("operation_id"), blocks).alias("block"),
                       *[_mask(F.col("operation_id"), i).alias(f"m{i}") for i in range(WORDS)])
    return keyed.groupBy("day", "block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def _earlier(spark: SparkSession, path: str, schema: str, stream: str, batch: int) -> DataFrame:
    """Rows that other streams and this one's earlier batches wrote."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, stream string, batch long").parquet(path)
    return rows.where((F.col("stream") != stream) | (F.col("batch") < batch)).drop("stream", "batch")


def possible_replays(rows: DataFrame, filters: DataFrame, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """``rows`` (day, operation_id, ...) with ``maybe``: the day's filter may hold the id."""
    merged = filters.groupBy("day", "block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])
    hit = F.lit(True)
    for i in range(WORDS):
        m = _mask(F.col("operation_id"), i)
        hit = hit & (F.col(f"w{i}").bitwiseAND(m) == m)
    return rows.withColumn("block", _block(F.col("operation_id"), blocks)).join(merged, ["day", "block"], "left") \
        .withColumn("maybe", F.coalesce(hit, F.lit(False))).select(*rows.columns, "maybe")


def drop_replays(batch: DataFrame, ledger: str, stream: str, number: int, scratch: Scratch,
                 blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """The batch's rows whose id is in no earlier batch's ledger, one an id."""
    spark = batch.sparkSession
    named = batch.where(F.col("operation_id").isNotNull()).dropDuplicates(["operation_id"])
    filters = _earlier(spark, f"{ledger}/filters", "block int, w0 long, w1 long, w2 long, w3 long, day date", stream, number)
    rows = named.withColumn("day", day_of(F.col("tx_ts")))
    probed = scratch.once(possible_replays(rows, filters, blocks))
    suspects = probed.where("maybe")
    days = [r.day for r in suspects.select("day").distinct().limit(1001).collect()]
    ids = _earlier(spark, f"{ledger}/ids", "operation_id string, day date", stream, number)
    if len(days) <= 1000:  # prunes the ledger's folders; a longer list costs more than it saves
        ids = ids.where(F.col("day").isin(days))
    fresh = probed.where(~F.col("maybe")).unionByName(suspects.join(ids, ["day", "operation_id"], "left_anti"))
    return fresh.select(*batch.columns).unionByName(batch.where(F.col("operation_id").isNull()))


def record_ids(fresh: DataFrame, ledger: str, stream: str, number: int, blocks: int = BLOOM_BLOCKS) -> None:
    """Enter a batch's rows in the ledger."""
    ids = fresh.where(F.col("operation_id").isNotNull()).select(day_of(F.col("tx_ts")).alias("day"), "operation_id")
    for name, table in (("ids", ids), ("filters", bloom_rows(ids, blocks))):
        # a file a day, but several for a large one
        table.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{ledger}/{name}/stream={stream}/batch={number}")


# ---- running counts -------------------------------------------------------------------------------------------

def _snapshots(spark: SparkSession, state: str, number: int) -> int:
    """The last snapshot that a batch before ``number`` wrote, or -1."""
    last = (number - 1) // SNAPSHOT * SNAPSHOT if number > 0 else -1
    while last >= 0 and not path_exists(spark, f"{state}/snapshot/batch={last}"):
        last -= SNAPSHOT
    return last


def stream_counts(spark: SparkSession, state: str, number: int) -> DataFrame:
    """(client_id, n): rows of each client in the stream's batches before ``number``."""
    schema, last = "client_id long, n long", _snapshots(spark, state, number)
    counts = spark.createDataFrame([], schema)
    if last >= 0:
        counts = spark.read.schema(schema).parquet(f"{state}/snapshot/batch={last}")
    if path_exists(spark, f"{state}/counts"):
        since = spark.read.schema(f"{schema}, batch long").parquet(f"{state}/counts")
        counts = counts.unionByName(since.where((F.col("batch") > last) & (F.col("batch") < number)).drop("batch"))
    return counts.groupBy("client_id").agg(F.sum("n").alias("n"))


def with_running_counts(batch: DataFrame, history: DataFrame, state: str, number: int, scratch: Scratch,
                        default: int = 1) -> DataFrame:
    """``batch`` with ``nb_transactions_client``: ``history`` (client_id, nb_transactions_client) plus the client's earlier
    rows of the stream, at least ``default``. Writes the batch's counts to ``state``."""
    spark = batch.sparkSession
    order = ["client_id", "tx_ts", "operation_id"]
    # written, so that a partition's number stays its rows' number
    rows = scratch.once(batch.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    per = scratch.once(rows.where(F.col("client_id").isNotNull()).groupBy("client_id", "__part").agg(
        F.count(F.lit(1)).alias("__n")))
    ahead = Window.partitionBy("client_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("client_id", "__part", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"))
    prior = scratch.once(stream_counts(spark, state, number))
    base = prior.withColumnRenamed("n", "__prior")
    inside = Window.partitionBy("__part", "client_id").orderBy("tx_ts", "operation_id")
    known = sum((F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("__history", "__prior", "__before")),
                F.row_number().over(inside) - 1)
    out = rows.join(offsets, ["client_id", "__part"], "left").join(base, "client_id", "left") \
        .join(history.select("client_id", F.col("nb_transactions_client").alias("__history")), "client_id", "left") \
        .withColumn("nb_transactions_client", F.when(F.col("client_id").isNull(), F.lit(default).cast("long"))
                    .otherwise(F.greatest(known, F.lit(default)).cast("long"))) \
        .select(*batch.columns, "nb_transactions_client")
    added = per.groupBy("client_id").agg(F.sum("__n").alias("n"))
    added.write.mode("overwrite").parquet(f"{state}/counts/batch={number}")
    if number % SNAPSHOT == 0:
        prior.unionByName(added).groupBy("client_id").agg(F.sum("n").alias("n")) \
            .write.mode("overwrite").parquet(f"{state}/snapshot/batch={number}")
    return out


# ---- the sink -------------------------------------------------------------------------------------------------

def run_into_journal(stream: DataFrame, journal: str, checkpoint: str, history: DataFrame,
                     score: Callable[[DataFrame], DataFrame], threshold: float = 0.5, ledger: str | None = None,
                     blocks: int = BLOOM_BLOCKS, after_write: Callable[[int], None] | None = None) -> None:
    """Score all available transactions of ``stream`` and append what the journal does not hold.

    ``history`` is (client_id, nb_transactions_client); ``score`` adds p_fraud, p_normal and p_suspect to transactions
    that have their count. The ledger belongs to the journal, whichever streams write to it (one after the other);
    the counts belong to the stream. ``after_write`` is called with each batch's number before its commit."""
    spark = stream.sparkSession
    ledger = ledger or f"{journal.rstrip('/')}_ledger"

    def sink(batch: DataFrame, number: int) -> None:
        scratch, own = Scratch(spark), stream_id(spark, checkpoint)
        try:
            fresh = scratch.once(drop_replays(batch, ledger, own, number, scratch, blocks))
            counted = with_running_counts(fresh, history, f"{checkpoint}/client_counts", number, scratch)
            append_journal(scoring_run(score(counted), threshold), journal, run=f"{own}-{number}")
            record_ids(fresh, ledger, own, number, blocks)
        finally:
            scratch.close()
        if after_write is not None:
            after_write(number)

    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
