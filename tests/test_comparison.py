"""The comparison table as it is shown: ranks, percentages, subset, number of models."""
import pytest
from pyspark.sql import functions as F

from fraudlens.operators import metrics as mt

METRICS = "accuracy double, precision_macro double, recall_macro double, f1_macro double, recall_fraude double"


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([
        ("a", 0, 0.9, 0.5, 0.5, 0.5, 0.61234), ("b", 1, 0.8, 0.5, 0.5, 0.5, 0.61231), ("c", 2, 0.12345, 0.5, 0.5, 0.5, 0.7),
        ("d", 3, 0.0, 0.0, 1.0, 0.66667, 0.0)], f"model string, fit_order int, {METRICS}")


def test_ranks_by_fraud_recall_and_ties_keep_fit_order(table):
    got = {r.model: r.rang for r in mt.comparison_view(table).collect()}
    assert got == {"c": 1, "a": 2, "b": 3, "d": 4}  # a and b are equal at four decimals


def test_percentages_have_one_decimal_half_up(table):
    got = {r.model: r for r in mt.comparison_view(table).collect()}
    assert got["c"].accuracy_pct == 12.3 and got["a"].recall_fraude_pct == 61.2
    assert (got["d"].accuracy_pct, got["d"].recall_macro_pct, got["d"].f1_macro_pct) == (0.0, 100.0, 66.7)
    half = table.limit(1).withColumn("accuracy", F.lit(0.1225))
    assert mt.comparison_view(half).first().accuracy_pct == 12.3


def test_a_subset_keeps_the_ranks_and_the_number_of_the_whole(table):
    got = mt.comparison_view(table, ["b", "c", "unknown"]).orderBy("rang").collect()
    assert [(r.model, r.rang, r.n_modeles) for r in got] == [("c", 1, 4), ("b", 3, 4)]
    for none in (None, []):
        assert mt.comparison_view(table, none).count() == 4


def test_verdicts_are_compared_in_one_scan(spark):
    rows = [("Fraude", 0.9), ("Fraude", 0.4), ("Normal", 0.6), ("Normal", 0.1), (None, 0.9), ("Fraude", None)]
    df = spark.createDataFrame(rows, "target string, p double")

    def at(t):
        return F.when(F.col("p") >= t, "Fraude").when(F.col("p") < t, "Normal")

    table = mt.compare_verdicts(df, {"low": at(0.3), "high": at(0.7)})
    got = {r.model: r for r in table.collect()}
    for name, t in (("low", 0.3), ("high", 0.7)):
        one = mt.model_metrics(df.withColumn("v", at(t)), "target", "v").first()
        assert {k: got[name][k] for k in mt.COMPARISON_METRICS} == one.asDict()
    assert [got[n].fit_order for n in ("low", "high")] == [0, 1]
    assert table._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
