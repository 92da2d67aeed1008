"""Invariants of the analytics and of the distributed algorithms."""
import math

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from fraudlens.operators import eda, metrics, split
from fraudlens.sources.tables import scored, transactions


@pytest.fixture(scope="module")
def tx(spark):
    df = transactions(spark, SF001).persist()
    yield df
    # a cached copy would answer later plan tests' scans from memory
    df.unpersist(blocking=True)


def test_shares_sum_to_100(tx):
    s = eda.target_distribution(tx).agg(F.sum("pourcentage")).collect()[0][0]
    assert s == pytest.approx(100.0, abs=1e-4)
    for r in eda.status_rate_by_hour(tx).collect():
        assert r["pct_normal"] + r["pct_suspect"] + r["pct_fraude"] == pytest.approx(100.0, abs=1e-4)


def test_confusion_sums_to_n(spark):
    sc = scored(spark, SF001).withColumn("predicted_status", F.lit("Normal"))
    total = metrics.confusion_matrix(sc).agg(F.sum("nombre")).collect()[0][0]
    assert total == sc.count()


def test_split_exact_and_partition_independent(spark, tx):
    a = split.stratified_split(tx)
    counts = {r["target"]: (r["n"], r["t"]) for r in
              a.groupBy("target").agg(F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    n = sum(k for k, _ in counts.values())
    assert sum(t for _, t in counts.values()) == math.ceil(0.2 * n)
    assert all(abs(t - 0.2 * k) < 1 for k, t in counts.values())
    b = split.stratified_split(tx.repartition(1))
    c = split.stratified_split(tx.repartition(13, "client_id"))
    ka = {r[0] for r in a.where("is_test").select("operation_id").collect()}
    assert ka == {r[0] for r in b.where("is_test").select("operation_id").collect()}
    assert ka == {r[0] for r in c.where("is_test").select("operation_id").collect()}


def test_fixture_numbers(spark):
    sc = scored(spark, SF001)
    assert metrics.roc_auc(sc).collect()[0]["auc"] == pytest.approx(0.944665, abs=1e-6)
    best = metrics.best_f1_threshold(sc).collect()[0]
    assert best["seuil"] == pytest.approx(0.7005) and best["f1"] == pytest.approx(0.54262, abs=1e-5)
    at_half = metrics.threshold_metrics(sc, 0.5).collect()[0]
    assert best["f1"] >= at_half["f1"]


def test_auc_equals_mllib_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    sc = scored(spark, SF001).select(F.col("p_fraud").alias("rawPrediction"),
                                     (F.col("target") == "Fraude").cast("double").alias("label"))
    ev = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(sc)
    assert ev == pytest.approx(0.944665398, abs=1e-7)


def test_running_sum_bucket_independent(spark, tx):
    from fraudlens.operators.cumulative import running_sum
    vc = tx.groupBy("amount").agg(F.count("*").alias("n"))
    a = {r["amount"]: r["n_cum"] for r in running_sum(vc, "amount", ["n"], buckets=1).collect()}
    b = {r["amount"]: r["n_cum"] for r in running_sum(vc, "amount", ["n"], buckets=37).collect()}
    assert a == b and max(a.values()) == tx.where(F.col("amount").isNotNull()).count()


def test_split_refuses_unknown_labels(spark, tx):
    with pytest.raises(split.UnknownLabelError):
        split.stratified_split(tx, classes=["Fraude", "Normal"])


def test_quotas_by_largest_remainder():
    assert split.class_quotas({"a": 7, "b": 7, "c": 7}, 0.2) == {"a": 2, "b": 2, "c": 1}
    assert split.class_quotas({"a": 1}, 0.2) == {"a": 1} and split.class_quotas({}, 0.2) == {}
    assert split.class_quotas({"Fraude": 387, "Normal": 7628, "Suspect": 1985}, 0.2) == {
        "Fraude": 77, "Normal": 1526, "Suspect": 397}


def test_describe_approx_close_to_exact(tx):
    exact = {r["statistique"]: r["valeur"] for r in eda.describe(tx).collect()}
    approx = {r["statistique"]: r["valeur"] for r in eda.describe(tx, exact=False).collect()}
    assert set(exact) == set(approx)
    for k in ("count", "mean", "std", "min", "max"):
        assert approx[k] == pytest.approx(exact[k])
    n = exact["count"]
    col = sorted(r[0] for r in tx.select("amount").where("amount is not null").collect())
    for k, p in (("25%", 0.25), ("50%", 0.5), ("75%", 0.75)):
        lo, hi = col[max(0, int(p * n) - int(n / 10_000) - 2)], col[min(len(col) - 1, int(p * n) + int(n / 10_000) + 2)]
        assert lo <= approx[k] <= hi
