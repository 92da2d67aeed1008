"""Streaming jobs: restart on the same checkpoint resumes without repeating
input; the streamed journal equals the batch journal."""
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF0001
from fraudlens.functions.scores import pseudo_probabilities
from fraudlens.operators.journal import journal_from_scored
from fraudlens.sources.tables import materialize_transactions, scored, transactions
from fraudlens.streaming import jobs


def test_restart_is_exactly_once(spark):
    base = tempfile.mkdtemp(prefix="fraudlens-stream-")
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "ckpt")

    def journal_stream():
        s = journal_from_scored(pseudo_probabilities(jobs.stream_transactions(spark, SF0001)), 0.5)
        return s.select(*jobs.JOURNAL_COLUMNS)

    first = jobs.run_available(journal_stream(), "restart", out=out, checkpoint=ckpt).count()
    second = jobs.run_available(journal_stream(), "restart", out=out, checkpoint=ckpt).count()
    assert first == second == transactions(spark, SF0001).count()


def test_stream_equals_batch(spark):
    streamed = jobs.streaming_scoring(spark, SF0001)
    batch = journal_from_scored(scored(spark, SF0001), 0.5).select(*jobs.JOURNAL_COLUMNS)
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_materialized_table_prunes_days(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="fraudlens-mat-"), "tx")
    t = materialize_transactions(spark, SF0001, path)
    day = t.select(F.min("tx_day")).collect()[0][0]
    sub = t.where(F.col("tx_day") == day)
    plan = sub._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "tx_day" in plan
    assert sub.count() == transactions(spark, SF0001).where(F.to_date("tx_ts") == day).count()


def test_a_table_of_part_files_streams_whole(spark):
    """Each streaming query over a table folder of three part files gives what it gives over one file."""
    from fraudlens.plans.registry import QUERIES
    base = tempfile.mkdtemp(prefix="fraudlens-parts-")
    for t in ("customer", "nation"):
        os.symlink(f"{SF0001}/{t}.parquet", f"{base}/{t}.parquet")
    spark.read.parquet(f"{SF0001}/events.parquet").repartition(3).write.parquet(f"{base}/events.parquet")
    assert jobs.streaming_scoring(spark, base).count() == transactions(spark, SF0001).count()
    for name in ("stream_static_client_count", "streaming_journal_kpis", "streaming_daily_trend", "streaming_dedup"):
        one, parts = QUERIES[name](spark, SF0001), QUERIES[name](spark, base)
        assert one.count() == parts.count() > 0
        assert one.exceptAll(parts).count() == 0 and parts.exceptAll(one).count() == 0, name


def test_daily_trend_holds_every_day(spark):
    got = jobs.streaming_daily_trend(spark, SF0001)
    want = (transactions(spark, SF0001).groupBy(F.to_date("tx_ts").alias("jour"), "target").count())
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
