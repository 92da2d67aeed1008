"""Model path on the smallest tables: metrics equal a pandas brute force,
artefacts round-trip, fit-or-load reuses saved artefacts, export writes CSV."""
import glob
import os
import tempfile
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest

from conftest import SF0001
from fraudlens.operators import models as M
from fraudlens.plans import training as T
from fraudlens.sources import files
from fraudlens.sources.tables import transactions


@pytest.fixture(scope="module")
def data(spark):
    return M.prepare_training(transactions(spark, SF0001))


@pytest.fixture(scope="module")
def lr(data):
    return M.fit_model(data, "logistic_regression")


def test_split_and_weights(data):
    tr = data.train.groupBy("target").agg({"weight": "first", "*": "count"}).toPandas()
    n = tr["count(1)"].sum()
    for _, r in tr.iterrows():
        assert r["first(weight)"] == pytest.approx(n / (3 * r["count(1)"]), rel=1e-5)


def test_metrics_match_bruteforce(lr, data):
    pred = M.class_probabilities(lr, data.test).toPandas()
    probs = pred[["p_fraude", "p_normal", "p_suspect"]].to_numpy()
    assert probs.sum(axis=1) == pytest.approx(1.0)
    got = M.evaluate(lr, data.test).collect()[0]
    y, p = pred["target"], pred["prediction_status"]
    classes = ["Fraude", "Normal", "Suspect"]
    rec = [((p == c) & (y == c)).sum() / max(1, (y == c).sum()) for c in classes]
    prec = [((p == c) & (y == c)).sum() / (p == c).sum() if (p == c).sum() else 0.0 for c in classes]
    assert got["accuracy"] == pytest.approx((p == y).mean(), abs=1e-6)
    assert got["recall_macro"] == pytest.approx(sum(rec) / 3, abs=1e-6)
    assert got["precision_macro"] == pytest.approx(sum(prec) / 3, abs=1e-6)
    assert got["recall_fraude"] == pytest.approx(rec[0], abs=1e-6)


def test_artefacts_round_trip(spark, lr, data):
    path = tempfile.mkdtemp(prefix="fraudlens-model-")
    M.save_artefacts(path, lr, data.vocab, {"model_nom": "logistic_regression", "threshold": 0.4})
    model, vocab, meta = M.load_artefacts(path)
    assert vocab.to_dict() == data.vocab.to_dict() and meta["threshold"] == 0.4
    a = M.class_probabilities(lr, data.test).select("operation_id", "p_fraude").toPandas().sort_values("operation_id")
    b = M.class_probabilities(model, data.test).select("operation_id", "p_fraude").toPandas().sort_values("operation_id")
    assert a["p_fraude"].to_numpy() == pytest.approx(b["p_fraude"].to_numpy())


SHORT = {"names": ["decision_tree"], "grids": {"decision_tree": {"max_depth": [3, 6], "min_samples_split": [2]}}}


def test_fit_or_load_trains_in_full_once(spark, data):
    path = tempfile.mkdtemp(prefix="fraudlens-fol-")
    assert T.fit_or_load(path, None) is None
    tx = transactions(spark, SF0001)
    model, _, meta1 = T.fit_or_load(path, tx, data=data, **SHORT)
    again, _, meta2 = T.fit_or_load(path, tx, data=data, **SHORT)
    assert meta1 == meta2 and meta1["model_nom"] == "decision_tree"
    # comparison, grid and threshold took place
    assert meta1["grid_search_best_params"] in ({"max_depth": d, "min_samples_split": 2} for d in (3, 6))
    assert 0 <= meta1["best_threshold_f1"] <= 1 and len(meta1["comparaison_modeles"]) == 1
    assert files.load_runs(spark, f"{path}/runs").count() == 1
    a, b = (sorted(map(str, M.class_probabilities(m, data.test).select("operation_id", "p_fraude").collect()))
            for m in (model, again))
    assert a == b


def test_damaged_artefacts_are_trained_again(spark, data):
    path = tempfile.mkdtemp(prefix="fraudlens-fol-")
    tx = transactions(spark, SF0001)
    model = M.fit_model(data, "decision_tree", max_depth=2)

    def part(pattern):
        version = sorted(os.listdir(f"{path}/published"))[-1].split("-", 1)[1]
        return sorted(glob.glob(f"{path}/versions/{version}/{pattern}", recursive=True))

    def cut(f):
        content = open(f, "rb").read()
        os.remove(f)
        open(f, "wb").write(content[:-3])

    for damage in (lambda: open(f"{path}/published/000000000099-none", "w").close(),
                   lambda: open(part("meta.json")[0], "w").write("{}"),
                   lambda: cut(part("model/nodes/*.parquet")[0]),
                   lambda: os.remove(part("model/hist/part-*")[0])):
        M.save_artefacts(path, model, data.vocab, {"model_nom": "old"})
        assert T.fit_or_load(path, None)[2] == {"model_nom": "old"}
        for crc in glob.glob(f"{path}/versions/*/.*.crc") + glob.glob(f"{path}/versions/*/model/*/.*.crc"):
            os.remove(crc)
        damage()
        with pytest.raises(M.BrokenArtefacts):
            M.load_artefacts(path)
    assert T.fit_or_load(path, tx, data=data, **SHORT)[2]["model_nom"] == "decision_tree"


def test_racing_writers_leave_one_whole_model(spark, data):
    path = tempfile.mkdtemp(prefix="fraudlens-race-")
    models = [M.fit_model(data, "decision_tree", max_depth=d) for d in (1, 2, 3)]

    def write(i):
        for _ in range(2):
            M.save_artefacts(path, models[i], data.vocab, {"depth": i + 1})
            model, _, meta = M.load_artefacts(path)  # another writer's, maybe, but whole
            assert model.nodes.selectExpr("max(length(node))").first()[0] == meta["depth"]

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    assert M.drop_old_versions(path) == 5
    model, _, meta = M.load_artefacts(path)
    assert model.nodes.selectExpr("max(length(node))").first()[0] == meta["depth"]


def test_tree_importances_and_grid(spark, data):
    model, table = M.grid_search(data, "decision_tree", {"max_depth": [2, 4], "min_samples_leaf": [1, 5]}, folds=3)
    assert table.count() == 4
    imp = {r.feature: r.importance for r in M.feature_importances(model, data.feature_columns, 50).collect()}
    assert set(imp) == set(data.feature_columns) and sum(imp.values()) == pytest.approx(1)
    used = {model.bins.columns[r.feature] for r in model.nodes.where("feature >= 0").collect()}
    assert {f for f, v in imp.items() if v > 0} <= used


def test_roc_auc_of_large_counts(spark):
    """Three thousand million rows of each class, as counts."""
    from pyspark.sql import functions as F
    from fraudlens.operators import metrics as mt
    ct = spark.createDataFrame([(0.9, 2 * 10 ** 9, 10 ** 9), (0.1, 10 ** 9, 2 * 10 ** 9)], "score double, pos long, neg long") \
        .withColumns({"tp": F.expr("sum(pos) over (order by score desc)"), "P": F.lit(3 * 10 ** 9), "N": F.lit(3 * 10 ** 9)})
    plain = mt.curve_table
    mt.curve_table = lambda *a: ct
    try:
        assert mt.roc_auc(None).first()[0] == pytest.approx(2 / 3, abs=1e-6)
    finally:
        mt.curve_table = plain


def test_export_csv(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="fraudlens-export-"), "journal_csv")
    files.export_csv(transactions(spark, SF0001).select("operation_id", "amount"), out)
    parts = glob.glob(os.path.join(out, "part-*.csv"))
    df = pd.concat([pd.read_csv(p) for p in parts])
    assert list(df.columns) == ["operation_id", "amount"] and len(df) == transactions(spark, SF0001).count()


def test_folds_are_stratified_and_whole(data):
    from fraudlens.operators.split import stratified_folds
    pdf = stratified_folds(data.train).select("operation_id", "target", "fold").toPandas()
    assert len(pdf) == data.train.count() and set(pdf["fold"]) == {0, 1, 2, 3, 4}
    for _, g in pdf.groupby("target"):
        per = g["fold"].value_counts()
        assert per.max() - per.min() <= 1


def test_grid_search_runs_the_whole_grid(data):
    model, table = M.grid_search(data, "logistic_regression", {"C": [0.1, 1]}, folds=3)
    rows = table.orderBy("grid_point").collect()
    assert [r["params"] for r in rows] == ['{"C": 0.1}', '{"C": 1}']
    assert all(0 < r["macro_recall_cv"] <= 1 for r in rows)
    best = max(rows, key=lambda r: (r["macro_recall_cv"], -r["grid_point"]))
    c = {0: 0.1, 1: 1}[best["grid_point"]]
    assert model.stages[-1].getRegParam() == pytest.approx(1 / (c * data.train.count()))
