"""Streams into the journal: crashes, replays of any age, hot ids and clients, running counts."""
import datetime as dt
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fraudlens.functions.scores import pseudo_probabilities
from fraudlens.sources.files import load_journal
from fraudlens.streaming import journal_sink as js

SCHEMA = ("operation_id string, client_id long, tx_type string, op_status string, location string, tx_ts timestamp, "
          "amount double, s10k long, k long")
START = dt.datetime(2024, 3, 1)


def tx(i, client, hour):
    return (None if i is None else f"op{i}", client, "ATM", "Validé", "Dakar",
            None if hour is None else START + dt.timedelta(hours=hour), 5.0, 100, 20)


def deliver(spark, folder, files):
    """One part file each, oldest first."""
    os.makedirs(folder, exist_ok=True)
    for rows in files:
        n = len(os.listdir(folder))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/../staging{n}")
        part = next(f for f in os.listdir(f"{folder}/../staging{n}") if f.endswith(".parquet"))
        os.replace(f"{folder}/../staging{n}/{part}", f"{folder}/{n:05d}.parquet")
        os.utime(f"{folder}/{n:05d}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def history(spark, counts):
    return spark.createDataFrame(list(counts.items()), "client_id long, nb_transactions_client long")


def run(spark, base, hist, name="c", **options):
    js.run_into_journal(stream(spark, f"{base}/in"), f"{base}/journal", f"{base}/{name}", hist, pseudo_probabilities, **options)


def rows_of(spark, base):
    return load_journal(spark, f"{base}/journal").collect()


def test_counts_see_earlier_rows_of_the_stream(spark, tmp_path, monkeypatch):
    """A hot client with most rows, clients of the history and new ones; snapshots included."""
    monkeypatch.setattr(js, "SNAPSHOT", 2)
    rng = random.Random(1)
    batches = [[tx(100 * b + i, 7 if i % 3 else rng.choice([1, 2, None, 50 + b]), rng.randint(0, 400)) for i in range(60)]
               for b in range(5)]
    past = {7: 10, 2: 3}
    deliver(spark, f"{tmp_path}/in", batches)
    run(spark, tmp_path, history(spark, past))
    got = {r.operation_id: r for r in rows_of(spark, tmp_path)}
    assert len(got) == 300
    seen = Counter(past)
    for rows in batches:
        for r in sorted(rows, key=lambda r: (r[5], r[0])):
            want = 1 if r[1] is None else max(1, seen[r[1]])
            assert got[r[0]].client_tx_count == want
            seen[r[1]] += r[1] is not None
    assert got["op0"].p_fraude == 1.0 and got["op0"].threshold == 0.5
    assert all(r.tx_ts and r.scored_at > dt.datetime(2025, 1, 1) for r in got.values())


@pytest.mark.parametrize("crash_at", [0, 1])
def test_a_crash_between_write_and_commit_repeats_nothing(spark, tmp_path, crash_at):
    batches = [[tx(10 * b + i, i % 3, 24 * b + i) for i in range(10)] for b in range(3)]
    deliver(spark, f"{tmp_path}/in", batches)
    hist = history(spark, {1: 4})

    def crash(number):
        if number == crash_at:
            raise RuntimeError("killed")

    with pytest.raises(Exception):
        run(spark, tmp_path, hist, after_write=crash)
    run(spark, tmp_path, hist)
    crashed = sorted((r.operation_id, r.client_tx_count) for r in rows_of(spark, tmp_path))
    plain = tmp_path / "plain"
    plain.mkdir()
    deliver(spark, f"{plain}/in", batches)
    run(spark, plain, hist)
    assert crashed == sorted((r.operation_id, r.client_tx_count) for r in rows_of(spark, plain))
    assert len(crashed) == 30
    run(spark, tmp_path, hist)  # nothing new
    assert len(rows_of(spark, tmp_path)) == 30


def test_replays_of_any_age_and_hot_ids(spark, tmp_path):
    first = [tx(i, i % 5, 24 * i) for i in range(40)] + [tx(3, 3, 72)] * 200  # a hot id
    late = [tx(1000 + i, 9, 24 * i) for i in range(20)]
    odd = [tx(None, 1, 5), tx(None, 1, 5), tx(77, 1, None), tx(77, 1, None)]
    deliver(spark, f"{tmp_path}/in", [first + odd, first[:30] + late, late + [tx(77, 1, None)] + first])
    hist = history(spark, {})
    run(spark, tmp_path, hist)
    got = Counter(r.operation_id for r in rows_of(spark, tmp_path))
    want = {f"op{i}": 1 for i in [*range(40), *range(1000, 1020), 77]} | {None: 2}
    assert got == want
    # all of it again by another stream, months later
    run(spark, tmp_path, hist, name="other")
    assert Counter(r.operation_id for r in rows_of(spark, tmp_path)) == want | {None: 4}


def test_filters_miss_nothing_and_few_others_hit(spark):
    held = spark.range(20_000).select(F.expr("date '2024-03-01'").alias("day"), F.col("id").cast("string").alias("operation_id"))
    blocks = 20_000 * 10 // 256
    filters = js.bloom_rows(held, blocks)
    assert filters.count() == blocks
    assert js.possible_replays(held, filters, blocks).where("not maybe").count() == 0
    others = held.select("day", F.concat(F.lit("x"), "operation_id").alias("operation_id"))
    rate = js.possible_replays(others, filters, blocks).where("maybe").count() / 20_000
    assert rate < 0.03, rate
    elsewhere = others.withColumn("day", F.expr("date '2024-03-02'"))
    assert js.possible_replays(elsewhere, filters, blocks).where("maybe").count() == 0
