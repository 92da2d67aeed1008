"""A third of all rows on one key: results stay exact (pandas brute force)."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from fraudlens.operators import eda, features, split
from fraudlens.operators.cumulative import exact_quantiles
from fraudlens.sources.tables import transactions


@pytest.fixture(scope="module")
def skewed(spark):
    tx = transactions(spark, SF001)
    # every third event belongs to one hot client
    df = tx.withColumn("client_id", F.when(F.col("op_num") % 3 == 0, F.lit(4242)).otherwise(F.col("client_id")))
    df = df.persist()
    yield df
    df.unpersist(blocking=True)


def test_client_counts_under_skew(skewed):
    got = features.with_client_tx_count(skewed).select("operation_id", "client_id", "nb_transactions_client").toPandas()
    pdf = skewed.select("operation_id", "client_id").toPandas()
    want = pdf.groupby("client_id")["operation_id"].transform("count")
    merged = got.merge(pdf.assign(want=want), on=["operation_id", "client_id"])
    assert len(merged) == len(pdf) and (merged["nb_transactions_client"] == merged["want"]).all()
    assert merged.loc[merged["client_id"] == 4242, "want"].iloc[0] == (pdf["client_id"] == 4242).sum()


def test_split_quota_under_skew(skewed):
    s = split.stratified_split(skewed, classes=["Fraude", "Normal", "Suspect"]).toPandas()
    assert s["is_test"].sum() == int(np.ceil(0.2 * len(s)))
    for _, g in s.groupby("target"):
        assert abs(g["is_test"].sum() - 0.2 * len(g)) < 1


def test_quartiles_per_hot_group(skewed):
    hot = skewed.withColumn("grp", F.when(F.col("client_id") == 4242, F.lit("hot")).otherwise(F.lit("rest")))
    got = {(r["grp"], r["p"]): r["q"] for r in exact_quantiles(hot, "amount", [0.25, 0.5, 0.9], ["grp"]).collect()}
    pdf = hot.select("grp", "amount").toPandas()
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile(pdf.loc[pdf["grp"] == g, "amount"], p), abs=1e-9)
    assert len(got) == 6


def test_location_rates_under_skew(skewed):
    got = eda.location_status_rate(skewed, 5).toPandas()
    assert len(got) == 5 and ((got["pct_normal"] + got["pct_suspect"] + got["pct_fraude"]).round(3) == 100.0).all()


def hot_split(spark, rows, partitions):
    df = spark.createDataFrame(rows, "operation_id string, target string, amount double").repartition(partitions)
    return split.stratified_split(df, classes=["Normal"]).toPandas()


def test_split_with_hot_copies_at_the_quota(spark):
    """5,000 rows of one id among 1,000 unique ids straddle the 20 % quota: the
    quota is exact, and the same rows are chosen at any number of partitions."""
    rows = [(f"u{i}", "Normal", float(i)) for i in range(1000)] + [("HOT", "Normal", float(j)) for j in range(5000)]
    chosen = []
    for partitions in (1, 3, 7):
        out = hot_split(spark, rows, partitions)
        assert len(out) == 6000 and out["is_test"].sum() == 1200
        chosen.append(set(map(tuple, out.loc[out["is_test"], ["operation_id", "amount"]].values)))
    assert chosen[0] == chosen[1] == chosen[2]
    # unique ids: test exactly when their hash sorts before the hot id's hash
    import hashlib
    h = {k: hashlib.md5(f"{k}:42".encode()).hexdigest() for k in out["operation_id"].unique()}
    uniq = out[out["operation_id"] != "HOT"]
    assert (uniq["is_test"] == uniq["operation_id"].map(lambda k: h[k] < h["HOT"])).all()


@pytest.mark.parametrize("step", [10_000, 7])
def test_split_with_equal_rows_at_the_quota(spark, monkeypatch, step):
    monkeypatch.setattr(split, "COPIES_PER_ROW", step)
    rows = [(f"u{i}", "Normal", float(i)) for i in range(1000)] + [("HOT", "Normal", 1.0)] * 5000
    out = hot_split(spark, rows, 5)
    assert len(out) == 6000 and out["is_test"].sum() == 1200
    assert (out["operation_id"] == "HOT").sum() == 5000 and out["operation_id"].nunique() == 1001
