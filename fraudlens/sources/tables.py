"""Readers for the driver's parquet tables and the `transactions` adapter view.

The adapter re-expresses the driver's star schema (events + customer + nation)
as the bank-transaction schema the analytics work on; the same text exists as
SQL in ``fraudlens.plans.oracle.TRANSACTIONS_CTE`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.functions.joins import MAX_BROADCAST_ROWS
from fraudlens.session import session_key

# Columns each table contributes (column pruning starts at the scan).
_EVENT_COLS = ["event_id", "ts", "user_id", "event_type", "value"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_ROW_COUNTS: dict = {}


def table_rows(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of a driver table (Parquet footers only), once per session."""
    key = (session_key(spark), sf_dir.rstrip("/"), name)
    if key not in _ROW_COUNTS:
        _ROW_COUNTS[key] = read_table(spark, sf_dir, name).count()
    return _ROW_COUNTS[key]


def client_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> nation name. nation is a fixed 25-row dimension, so the
    broadcast has a proven size bound. customer grows with the data: it is
    marked for broadcast only when its row count is within
    ``MAX_BROADCAST_ROWS``; beyond that the planner shuffles both sides
    (sort-merge join, with AQE splitting a hot client)."""
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    loc = (cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left")
           .select(F.col("c_custkey"), F.col("n_name").alias("location")))
    return F.broadcast(loc) if table_rows(spark, sf_dir, "customer") <= MAX_BROADCAST_ROWS else loc


def transactions(spark: SparkSession, sf_dir: str, with_oracle_cols: bool = True) -> DataFrame:
    """Bank transactions derived from the driver tables.

    Output: client_id, account_no, operation_id, op_num, tx_type, op_status,
    location, tx_ts, amount, target, and (with_oracle_cols) s10k, k — the two
    integer seeds of the deterministic pseudo-scores; they leak the target and
    are never model features.
    """
    ev = read_table(spark, sf_dir, "events").select(*_EVENT_COLS)
    return transactions_from_events(ev, client_locations(spark, sf_dir), with_oracle_cols)


def transactions_from_events(ev: DataFrame, loc: DataFrame, with_oracle_cols: bool = True) -> DataFrame:
    """The adapter body; ``ev`` may be a batch or a streaming DataFrame (the
    location lookup is then a stream-static left join)."""
    j = ev.join(loc, ev.user_id == loc.c_custkey, "left")

    ts = F.col("ts").cast("timestamp")
    eid = F.col("event_id")
    h = (eid * 7919 + F.col("user_id") * 104729) % 1000
    night = F.when((F.hour(ts) >= 22) | (F.hour(ts) < 6), F.lit(1)).otherwise(F.lit(0))
    big = F.when(F.col("value") > 100, F.lit(1)).otherwise(F.lit(0))
    base = j.select(
        F.col("user_id").alias("client_id"),
        (F.col("user_id") + 100000).alias("account_no"),
        eid.cast("string").alias("operation_id"),
        eid.alias("op_num"),
        F.col("event_type").alias("tx_type"),
        F.when(eid % 10 < 7, "Validé").when(eid % 10 < 9, "Echoué").otherwise("En attente").alias("op_status"),
        F.col("location"),
        ts.alias("tx_ts"),
        F.col("value").alias("amount"),
        h.alias("h"), night.alias("night"), big.alias("big"),
    )
    target = (F.when(F.col("h") < 15 + 50 * F.col("night") + 60 * F.col("big"), "Fraude")
              .when(F.col("h") < 240, "Suspect").otherwise("Normal"))
    cols = [F.col(c) for c in ("client_id", "account_no", "operation_id", "op_num", "tx_type",
                                "op_status", "location", "tx_ts", "amount")]
    cols.append(target.alias("target"))
    if with_oracle_cols:
        cols.append((5 * (1000 - F.col("h")) + 2000 * F.col("night") + 2000 * F.col("big")
                     + 10 * ((F.col("op_num") * 31) % 100)).alias("s10k"))
        cols.append((20 + (F.col("op_num") * 17) % 61).alias("k"))
    return base.select(*cols)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """transactions + deterministic pseudo-probabilities (same text as the oracle)."""
    from fraudlens.functions.scores import pseudo_probabilities
    return pseudo_probabilities(transactions(spark, sf_dir))


def materialize_transactions(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """Write the adapter output once as a Parquet table partitioned by day (in
    a shared folder) and return it: many analytics over the same data then
    scan one table instead of re-running the events x customer join, date
    filters prune partitions, and the lineage is cut."""
    tx = transactions(spark, sf_dir).withColumn("tx_day", F.to_date("tx_ts"))
    tx.write.mode("overwrite").partitionBy("tx_day").parquet(path)
    return spark.read.parquet(path)
