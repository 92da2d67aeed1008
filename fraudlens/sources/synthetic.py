"""Synthetic transactions with the raw schema, for trying the tools without a
real file. Library only (not a registered query): its input is made up.

Every value is a function of (row id, seed) through xxhash64, so the output
does not depend on partitioning (unlike ``rand(seed)``) and a lost partition
is regenerated identically.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.schema import SYNTH_LOCATIONS, SYNTH_OP_STATUSES, SYNTH_TX_TYPES


def _u(seed: int, stream: str) -> Column:
    """Uniform [0, 1) for the current row id."""
    h = F.xxhash64(F.col("id"), F.lit(seed), F.lit(stream))
    return F.pmod(h, F.lit(1 << 52)).cast("double") / float(1 << 52)


def _int(seed: int, stream: str, lo: int, hi: int) -> Column:
    return (F.lit(lo) + F.floor(_u(seed, stream) * (hi - lo))).cast("long")


def _choice(seed: int, stream: str, values: list[str]) -> Column:
    arr = F.array(*[F.lit(v) for v in values])
    return F.element_at(arr, (F.floor(_u(seed, stream) * len(values)) + 1).cast("int"))


def synthetic_transactions(spark: SparkSession, n: int = 2000, seed: int = 42,
                           num_partitions: int | None = None) -> DataFrame:
    base = spark.range(0, n, numPartitions=num_partitions) if num_partitions else spark.range(0, n)
    # log-normal(10.5, 1.1) amount via Box-Muller on two hashed uniforms
    u1 = F.greatest(_u(seed, "a1"), F.lit(1e-12))
    z = F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * math.pi * _u(seed, "a2"))
    draw = _u(seed, "target")
    target = F.when(draw < 0.037, "Fraude").when(draw < 0.24, "Suspect").otherwise("Normal")
    ts = (F.lit("2025-01-01 00:00:00").cast("timestamp")
          + F.make_interval(days=_int(seed, "day", 0, 200).cast("int"), secs=_int(seed, "sec", 0, 86400).cast("int")))
    return base.select(
        _int(seed, "client", 1000, 1200).alias("client_id"),
        _int(seed, "account", 100000, 999999).alias("account_no"),
        F.format_string("TR%d/%04d", _int(seed, "op", 100, 999), F.col("id")).alias("operation_id"),
        _choice(seed, "type", SYNTH_TX_TYPES).alias("tx_type"),
        _choice(seed, "status", SYNTH_OP_STATUSES).alias("op_status"),
        _choice(seed, "loc", SYNTH_LOCATIONS).alias("location"),
        ts.alias("tx_ts"),
        F.round(F.exp(F.lit(10.5) + F.lit(1.1) * z), 0).alias("amount"),
        target.alias("target"),
    )
