"""Null and edge rules on the FIXTURES micro-fixtures."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from fraudlens.functions.columns import clipped_log_amount, log_amount, tolerant_timestamp
from fraudlens.functions.scores import verdict
from fraudlens.operators import eda, features, metrics
from fraudlens.operators.journal import run_deltas

TX_SCHEMA = ("client_id long, account_no long, operation_id string, tx_type string, op_status string, "
             "location string, tx_ts timestamp, amount double, target string")


def tx(spark, rows):
    return spark.createDataFrame(rows, TX_SCHEMA)


def row(**kw):
    base = dict(client_id=1, account_no=1, operation_id="x", tx_type="ATM", op_status="Validé", location="Dakar",
                tx_ts=dt.datetime(2025, 1, 6, 10), amount=10.0, target="Normal")
    base.update(kw)
    return tuple(base[k] for k in ["client_id", "account_no", "operation_id", "tx_type", "op_status", "location",
                                   "tx_ts", "amount", "target"])


def test_bad_date(spark):
    df = spark.createDataFrame([("2025-01-02 10:00:00",), ("garbage",), (None,)], "raw string")
    out = features.base_features(df.select(tolerant_timestamp(F.col("raw")).alias("tx_ts"),
                                           F.lit(None).cast("string").alias("location"),
                                           F.lit(None).cast("double").alias("amount"))).collect()
    assert out[0]["tx_ts"] == dt.datetime(2025, 1, 2, 10)
    assert [r["tx_ts"] for r in out[1:]] == [None, None]
    assert [r["est_nuit"] for r in out[1:]] == [0, 0]
    assert [r["est_weekend"] for r in out[1:]] == [0, 0]


def test_null_client(spark):
    df = tx(spark, [row(client_id=1, operation_id="a"), row(client_id=1, operation_id=None),
                    row(client_id=None, operation_id="c"), row(client_id=2, operation_id="d")])
    df = df.withColumn("k", F.monotonically_increasing_id())
    out = features.with_client_tx_count(df).orderBy("k").collect()
    assert [r["nb_transactions_client"] for r in out] == [1, 1, None, 1]


def test_null_target(spark):
    df = tx(spark, [row(target="Fraude"), row(target="Normal"), row(target="Normal"), row(target=None)])
    k = eda.kpis(df).collect()[0]
    assert k["taux_fraude"] == pytest.approx(25.0)
    dist = {r["statut"]: r["nombre"] for r in eda.target_distribution(df).collect()}
    assert dist == {"Fraude": 1, "Suspect": 0, "Normal": 2}


def test_empty(spark):
    k = eda.kpis(tx(spark, [])).collect()[0]
    assert k["taux_fraude"] == 0.0 and k["taux_suspect"] == 0.0
    assert k["date_min"] is None and k["date_max"] is None


def test_location_variant_and_null(spark):
    df = tx(spark, [row(location="Saint-Louis"), row(location="Saint Louis"), row(location=None)])
    f = features.base_features(df)
    g = features.group_locations(f, features.top_location_frame(f)).collect()
    assert sorted(r["location_grp"] for r in g) == ["Autre", "Saint Louis", "Saint Louis"]


def test_one_hot(spark):
    df = spark.createDataFrame([("1", "b"), ("2", "a"), ("3", None), ("4", "c")], "operation_id string, tx_type string")
    df = df.withColumns({"op_status": F.lit("v"), "location_grp": F.lit("x")})
    vocab = features.Vocabulary([], {"tx_type": ["a", "b", "c"], "op_status": ["v"], "location_grp": ["x"]})
    wide = df.select("operation_id", *features.one_hot_columns(vocab)).orderBy("operation_id").collect()
    assert [r["tx_type_b"] for r in wide] == [1, 0, 0, 0]
    assert [r["tx_type_c"] for r in wide] == [0, 0, 0, 1]
    assert "tx_type_a" not in wide[0].asDict()
    long = features.one_hot_long(df, vocab).where(F.col("feature").startswith("tx_type")).collect()
    assert sorted((r["operation_id"], r["feature"]) for r in long) == [("1", "tx_type_b"), ("4", "tx_type_c")]


def test_amount_edge(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (None,)], "a double")
    out = df.select(log_amount(F.col("a")).alias("l"), clipped_log_amount(F.col("a")).alias("c")).collect()
    assert [r["l"] for r in out] == [None, None, 0.0, None]
    assert [r["c"] for r in out] == [0.0, 0.0, 0.0, None]


def test_constant_column_and_pairwise_null(spark):
    df = tx(spark, [row(amount=1.0, tx_ts=dt.datetime(2025, 1, 6, 1)), row(amount=2.0, tx_ts=dt.datetime(2025, 1, 6, 1)),
                    row(amount=3.0, tx_ts=dt.datetime(2025, 1, 6, 1))])
    m = {(r["var_x"], r["var_y"]): r["r"] for r in eda.correlation_matrix(df).collect()}
    assert m[("montant", "heure")] is None        # constant hour: NULL, no error
    assert m[("montant", "montant")] == pytest.approx(1.0)
    df2 = tx(spark, [row(amount=1.0, client_id=1), row(amount=2.0, client_id=None), row(amount=5.0, client_id=2)])
    m2 = {(r["var_x"], r["var_y"]): r["r"] for r in eda.correlation_matrix(df2).collect()}
    assert m2[("montant", "nb_transactions_client")] is None  # constant on the 2 complete pairs


def test_duplicates(spark):
    df = spark.createDataFrame([(1,), (None,), (None,)], "a long")
    assert eda.data_quality_profile(df, ["a"]).collect()[0]["doublons"] == 1


def test_quartiles(spark):
    df = tx(spark, [row(amount=v) for v in (1.0, 2.0, 3.0, 10.0)])
    d = {r["statistique"]: r["valeur"] for r in eda.describe(df).collect()}
    assert (d["25%"], d["50%"], d["75%"]) == (1.75, 2.5, 4.75)
    assert d["std"] == pytest.approx(4.0824829, abs=1e-6)


def test_tie_topk(spark):
    df = tx(spark, [row(location=v) for v in "babbc" if True][:0] + [row(location=v) for v in ["b", "a", "a", "b", "c"]])
    assert [r["location"] for r in eda.top_locations(df, 1).collect()] == ["a"]


def test_domain_gap(spark):
    df = tx(spark, [row(tx_ts=dt.datetime(2025, 1, 6, 10)), row(tx_ts=dt.datetime(2025, 1, 13, 11))])  # Mondays
    out = eda.status_rate_by_weekday(df).orderBy("jour_num").collect()
    assert len(out) == 7
    assert out[0]["jour"] == "Lundi" and out[0]["pct_normal"] == 100.0
    assert sum(r["pct_normal"] is None for r in out) == 6


def test_f1_tie(spark):
    # scores and labels built so that thresholds 0.15 and 0.2 reach the same best F1
    df = spark.createDataFrame([(0.2, "Fraude"), (0.15, "Normal"), (0.15, "Fraude"), (0.1, "Normal"), (0.05, "Normal")],
                               "p_fraud double, target string")
    best = metrics.best_f1_threshold(df).collect()[0]
    pts = metrics.curve_table(df).collect()
    f1 = {r["score"]: 2 * r["tp"] / (r["tp"] + r["fp"] + r["P"]) for r in pts}
    top = max(f1.values())
    assert best["seuil"] == min(s for s, v in f1.items() if v == top)


def test_verdict_tie(spark):
    df = spark.createDataFrame([(0.2, 0.4, 0.4)], "pf double, pn double, ps double")
    assert df.select(verdict(F.col("pf"), F.col("pn"), F.col("ps"), 0.5)).collect()[0][0] == "Normal"


def test_no_positive_pred(spark):
    df = spark.createDataFrame([(0.9, "Fraude"), (0.2, "Normal")], "p_fraud double, target string")
    m = metrics.threshold_metrics(df, 1.1).collect()[0]
    assert (m["precision"], m["rappel"], m["f1"]) == (0.0, 0.0, 0.0)


def test_two_runs(spark):
    runs = spark.createDataFrame([(dt.datetime(2025, 1, 1), 0.90, 0.5, 0.5), (dt.datetime(2025, 1, 2), 0.92, 0.5, 0.5)],
                                 "horodatage timestamp, accuracy double, rappel_fraude double, f1_fraude double")
    d = run_deltas(runs).collect()
    assert len(d) == 1 and d[0]["delta_accuracy"] == pytest.approx(0.02)
    assert run_deltas(runs.limit(1)).count() == 0
