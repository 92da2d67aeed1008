"""Scaling and supervised models: logistic regression of Spark MLlib, trees of ``histtrees``.

Weighted fit, unweighted evaluation: every estimator gets the balanced class
weight column; metrics are computed on the untouched test rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from itertools import product

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraudlens.functions.scores import verdict
from fraudlens.operators import histtrees as ht
from fraudlens.operators.features import Vocabulary, enrich, feature_matrix, label_index
from fraudlens.operators.metrics import RANK_DECIMALS
from fraudlens.operators.split import stratified_folds, stratified_split, with_class_weights
from fraudlens.schema import LABEL_ORDER
from fraudlens.session import written_once


@dataclass
class Scaler:
    """Per-feature mean and population standard deviation fitted on train rows
    (zero spread -> scale 1, so a constant feature maps to 0)."""
    columns: list[str]
    means: list[float]
    scales: list[float]


def fit_scaler(train: DataFrame, columns: list[str]) -> Scaler:
    aggs = []
    for c in columns:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    row = train.agg(*aggs).collect()[0]  # one row: 2 numbers per feature
    means = [float(row[f"m_{c}"] or 0.0) for c in columns]
    scales = [float(row[f"s_{c}"]) if row[f"s_{c}"] else 1.0 for c in columns]
    return Scaler(list(columns), means, scales)


def apply_scaler(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                           for c, m, s in zip(scaler.columns, scaler.means, scaler.scales)})


# =========================================================================== MLlib training




MODEL_NAMES = ["logistic_regression", "decision_tree", "random_forest", "gradient_boosting"]
OVR_BOOSTING = "gradient_boosting_ovr"  # binary boosting as MLlib's, one class against the rest


@dataclass
class TrainingData:
    train: DataFrame          # key, target, label, weight, feature columns
    test: DataFrame
    vocab: Vocabulary
    feature_columns: list[str]
    quarantined: int          # rows dropped from training for a null feature


def prepare_training(tx: DataFrame, test_fraction: float = 0.2, seed: int = 42,
                     key: str = "operation_id") -> TrainingData:
    """Features (vocabulary fitted on the whole table, as the studied code does),
    exact stratified split, label codes, balanced weights on the train rows."""
    feat, vocab = enrich(tx)
    feat = stratified_split(feat, key=key, test_fraction=test_fraction, seed=seed, classes=LABEL_ORDER)
    cols = vocab.feature_columns()
    fm = feature_matrix(feat, vocab, keep=[key, "target", "is_test", "tx_ts", "amount"])
    fm = fm.withColumn("label", label_index(F.col("target")).cast("double"))
    complete = F.lit(True)
    for c in cols + ["label"]:
        complete = complete & F.col(c).isNotNull()
    # The split feature matrix is written once to the shared folder and feeds the
    # quarantine count, the class weights, every fit, CV fold and evaluation; it
    # holds no executor memory between them.
    fm = written_once(fm.withColumn("__complete", complete), "feature_matrix")
    quarantined = fm.where(~F.col("__complete")).count()
    fm = fm.where(F.col("__complete")).drop("__complete")
    train = with_class_weights(fm.where(~F.col("is_test")), "target", "weight")
    test = fm.where(F.col("is_test"))
    return TrainingData(train, test, vocab, cols, quarantined)


def _assembler_stages(cols: list[str], invalid: str = "error"):
    return [VectorAssembler(inputCols=cols, outputCol="__raw", handleInvalid=invalid),
            StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True)]


Model = PipelineModel | ht.TreeModel | ht.Boosted


def make_estimator(name: str, n_train: int | None = None, seed: int = 42, **params):
    """Weighted MLlib estimator of a model that MLlib has."""
    if name == "logistic_regression":
        c = params.get("C", 1.0)
        # sklearn minimises C * sum(w * loss) + |b|^2 / 2; MLlib minimises
        # sum(w * loss) / sum(w) + regParam * |b|^2 / 2 -> regParam = 1 / (C * sum(w)),
        # and sum(w) = n_train under balanced weights.
        reg = 1.0 / (c * max(1, n_train or 1))
        return LogisticRegression(family="multinomial", maxIter=params.get("maxIter", 5000), regParam=reg,
                                  elasticNetParam=0.0, standardization=False, weightCol="weight",
                                  tol=params.get("tol", 1e-4))
    raise ValueError(f"unknown model {name}")


def fit_model(data: TrainingData, name: str, **params) -> Model:
    """Fit a model on the train rows with balanced weights. Trees take n_estimators, max_depth (None: no limit),
    min_samples_split, min_samples_leaf, learning_rate, as far as they have them."""
    n_train = params.pop("n_train", None)
    cols, trees = data.feature_columns, params.pop("n_estimators", 100)
    if name == "decision_tree":
        return ht.fit_tree(data.train, cols, ht.TreeParams(**params))
    if name == "random_forest":
        return ht.fit_forest(data.train, cols, trees, ht.TreeParams(max_features=max(1, int(len(cols) ** 0.5)), **params))
    if name in ("gradient_boosting", OVR_BOOSTING):
        rows, bins = ht.binned_training(data.train, cols)
        rate = params.pop("learning_rate", 0.1)
        return ht.boosted(rows, bins, ht.class_weights(data.train), trees, rate=rate, one_vs_rest=name == OVR_BOOSTING,
                          **params)
    if name == "logistic_regression" and n_train is None:
        n_train = data.train.count()
    est = make_estimator(name, n_train=n_train, **params)
    return Pipeline(stages=_assembler_stages(data.feature_columns) + [est]).fit(data.train)


def _classifier(model: PipelineModel):
    return model.stages[-1]


def class_probabilities(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds p_fraude, p_normal, p_suspect (by label code, never by position of
    a display order) and ``prediction_status`` (arg-max class)."""
    if not isinstance(model, PipelineModel):
        return _with_status(model.probabilities(df), df.columns, [F.col(c) for c in ht.PROBABILITIES])
    clf = _classifier(model)
    feats = df
    for stage in model.stages[:-1]:
        feats = stage.transform(feats)
    if hasattr(clf, "models"):  # one-vs-rest: per-class binary probability, renormalised
        cur = feats
        for i, m in enumerate(clf.models):
            m2 = m.copy()
            m2.setProbabilityCol(f"__prob{i}").setRawPredictionCol(f"__raw{i}").setPredictionCol(f"__pred{i}")
            cur = m2.transform(cur).withColumn(f"__p{i}", vector_to_array(F.col(f"__prob{i}"))[1]) \
                .drop(f"__prob{i}", f"__raw{i}", f"__pred{i}")
        tot = sum((F.col(f"__p{i}") for i in range(len(clf.models))), F.lit(0.0))
        out = cur.withColumns({f"__q{i}": F.col(f"__p{i}") / tot for i in range(len(clf.models))})
        probs = [F.col(f"__q{i}") for i in range(len(LABEL_ORDER))]
    else:
        out = clf.transform(feats).withColumn("__arr", vector_to_array(F.col("probability")))
        probs = [F.col("__arr")[i] for i in range(len(LABEL_ORDER))]
    return _with_status(out, df.columns, probs)


def _with_status(out: DataFrame, columns: list[str], probs: list[Column]) -> DataFrame:
    best = F.greatest(*probs)
    pred = F.when(probs[0] == best, LABEL_ORDER[0]).when(probs[1] == best, LABEL_ORDER[1]).otherwise(LABEL_ORDER[2])
    out = out.withColumns({"p_fraude": probs[0], "p_normal": probs[1], "p_suspect": probs[2], "prediction_status": pred})
    return out.select(*columns, "p_fraude", "p_normal", "p_suspect", "prediction_status")


def score_with_threshold(model: PipelineModel, df: DataFrame, threshold: float) -> DataFrame:
    """Class probabilities plus the thresholded verdict."""
    p = class_probabilities(model, df)
    return p.withColumn("predicted_status", verdict(F.col("p_fraude"), F.col("p_normal"), F.col("p_suspect"), threshold))


def evaluate(model: PipelineModel, test: DataFrame) -> DataFrame:
    """Unweighted test metrics of the arg-max prediction (one row)."""
    from fraudlens.operators.metrics import model_metrics
    return model_metrics(class_probabilities(model, test), "target", "prediction_status")


def compare_models(data: TrainingData, names: list[str] | None = None, params: dict | None = None,
                   keep_models: bool = False) -> tuple[DataFrame, dict]:
    """Fit every model with balanced weights and rank them by fraud recall at
    four decimals (ties keep fit order). Returns the comparison table and, with
    ``keep_models``, the fitted models (otherwise each is released after its
    evaluation, so large forests never coexist in the heap)."""
    names = names or MODEL_NAMES
    params = params or {}
    spark = data.train.sparkSession
    n_train = data.train.count()
    fitted, rows = {}, []
    for order, name in enumerate(names):
        m = fit_model(data, name, n_train=n_train, **params.get(name, {}))
        r = evaluate(m, data.test).collect()[0].asDict()  # one row of 5 metrics
        if keep_models:
            fitted[name] = m
        del m
        rows.append({"model": name, "fit_order": order, **r})
    table = spark.createDataFrame(rows).select("model", "fit_order", "accuracy", "precision_macro", "recall_macro",
                                               "f1_macro", "recall_fraude")
    w = Window.orderBy(F.round("recall_fraude", RANK_DECIMALS).desc(), F.asc("fit_order"))  # over <= 4 rows
    return table.withColumn("rang", F.row_number().over(w)), fitted


class MacroRecallEvaluator(Evaluator):
    """Mean of per-class recall (the CV score of the studied code); computed by
    one aggregation over (label, prediction)."""

    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self.labelCol = labelCol
        self.predictionCol = predictionCol

    def _evaluate(self, dataset: DataFrame) -> float:
        per = (dataset.groupBy(self.labelCol)
               .agg(F.avg((F.col(self.predictionCol) == F.col(self.labelCol)).cast("double")).alias("r")))
        v = per.agg(F.avg("r")).collect()[0][0]
        return float(v or 0.0)

    def isLargerBetter(self) -> bool:
        return True


# Hyper-parameter grids (None: no limit of depth).
FULL_GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1, 10]},
    "decision_tree": {"max_depth": [None, 5, 10, 15, 20], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4]},
    "random_forest": {"n_estimators": [100, 200, 300], "max_depth": [None, 8, 12, 20], "min_samples_split": [2, 5, 10]},
    "gradient_boosting": {"n_estimators": [100, 200, 300], "max_depth": [2, 3, 4], "learning_rate": [0.05, 0.1, 0.2]},
}


def search_table(data: TrainingData, name: str, grid: dict | None = None, folds: int = 5,
                 parallelism: int = 2) -> tuple[list[dict], DataFrame]:
    """k-fold CV on the train rows in class-stratified folds, scored by macro
    recall (weighted fit, unweighted score); returns (grid points, table of results)."""
    grid = grid if grid is not None else FULL_GRIDS[name]
    train = written_once(stratified_folds(data.train, folds), "folds")
    if name == "logistic_regression":
        points, metrics = _search_regression(data, train, grid, folds, parallelism)
    elif name == "gradient_boosting":
        points, metrics = ht.search_boosting(train, data.feature_columns, grid, folds)
    else:
        points, metrics = ht.search_trees(train, data.feature_columns, grid, folds, forest=name == "random_forest")
    rows = [{"grid_point": i, "params": json.dumps(p, sort_keys=True), "macro_recall_cv": m}
            for i, (p, m) in enumerate(zip(points, metrics))]
    return points, train.sparkSession.createDataFrame(rows)


def _search_regression(data: TrainingData, train: DataFrame, grid: dict, folds: int,
                       parallelism: int) -> tuple[list[dict], list[float]]:
    n_fold = train.count() * (folds - 1) // folds  # what a fold's fit sees: the penalty of a given C depends on it
    points = [dict(zip(grid, values)) for values in product(*grid.values())]
    est = make_estimator("logistic_regression", n_train=n_fold)
    maps = [{est.regParam: 1.0 / (p["C"] * max(1, n_fold))} for p in points]
    cv = CrossValidator(estimator=Pipeline(stages=_assembler_stages(data.feature_columns) + [est]), estimatorParamMaps=maps,
                        evaluator=MacroRecallEvaluator(), foldCol="fold", numFolds=folds, parallelism=parallelism,
                        seed=42)
    return points, [float(m) for m in cv.fit(train).avgMetrics]


def grid_search(data: TrainingData, name: str, grid: dict | None = None, folds: int = 5,
                parallelism: int = 2) -> tuple[Model, DataFrame]:
    """(model refitted on all train rows at the best point, the first of equal ones; table of grid results)."""
    points, table = search_table(data, name, grid, folds, parallelism)
    best = table.orderBy(F.desc("macro_recall_cv"), F.asc("grid_point")).first()
    return fit_model(data, name, **points[best["grid_point"]]), table


def feature_importances(model: PipelineModel, feature_columns: list[str], top: int = 12) -> DataFrame | None:
    """Top feature importances of a tree model; None when the model has none."""
    if isinstance(model, ht.TreeModel):
        return model.importances().orderBy(F.desc("importance"), F.asc("feature")).limit(top)
    clf = _classifier(model) if isinstance(model, PipelineModel) else None
    if not hasattr(clf, "featureImportances"):
        return None
    imp = clf.featureImportances.toArray().tolist()
    spark = _active_spark()
    rows = [{"feature": f, "importance": float(v)} for f, v in zip(feature_columns, imp)]
    df = spark.createDataFrame(rows)
    return df.orderBy(F.desc("importance"), F.asc("feature")).limit(top)


def _active_spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


# --------------------------------------------------------------------------- artefacts
# Every save is a folder of its own below ``versions``. It is published by the rename of a written file to a name of
# its own below ``published``, of which the last in the order of names counts. So no file is ever replaced: a reader sees
# the old model or the new one, whole, and of racing writers one is current and the others' versions are whole too.
PUBLISHED = "published"


class BrokenArtefacts(ValueError):
    """No artefacts were published, or the published ones are damaged."""


def _files(path: str) -> tuple:
    """(Hadoop file system, path) of a text path."""
    spark = _active_spark()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _listing(path: str) -> dict[str, int]:
    """Lengths of the files below a folder, by relative path; checksums and markers apart."""
    fs, root = _files(path)
    root = fs.makeQualified(root)
    found, it = {}, fs.listFiles(root, True)
    while it.hasNext():
        f = it.next()
        name = f.getPath().toString()[len(root.toString()) + 1:]
        if not name.rsplit("/", 1)[-1].startswith((".", "_")):
            found[name] = f.getLen()
    return found


def _write_text(path: str, text: str) -> None:
    fs, p = _files(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(path: str) -> str:
    fs, p = _files(path)
    stream = fs.open(p)
    try:
        return _active_spark()._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _published(path: str) -> list[str]:
    """Names (number-version) of the published versions, the current one last."""
    fs, folder = _files(f"{path}/{PUBLISHED}")
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _publish(path: str, version: str) -> None:
    fs, folder = _files(f"{path}/{PUBLISHED}")
    fs.mkdirs(folder)
    names = _published(path)
    number = int(names[-1].split("-")[0]) + 1 if names else 0
    if not fs.rename(_files(f"{path}/versions/{version}/pointer")[1], _files(f"{path}/{PUBLISHED}/{number:012d}-{version}")[1]):
        raise OSError(f"cannot publish {version} in {path}")


def save_artefacts(path: str, model: Model, vocab: Vocabulary, meta: dict) -> None:
    """Write model, fitted vocabulary and metadata as a new version and publish it."""
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    if isinstance(model, PipelineModel):
        model.write().overwrite().save(f"{folder}/model")
    else:
        ht.save_model(_active_spark(), f"{folder}/model", model)
    doc = {"kind": "pipeline" if isinstance(model, PipelineModel) else "hist", "vocab": vocab.to_dict(), "meta": meta,
           "files": _listing(f"{folder}/model")}
    _write_text(f"{folder}/meta.json", json.dumps(doc, sort_keys=True))
    _write_text(f"{folder}/pointer", version)
    _publish(path, version)


def artefacts_exist(path: str) -> bool:
    return bool(_published(path))


def load_artefacts(path: str) -> tuple[Model, Vocabulary, dict]:
    """The published version. Raises BrokenArtefacts where there is none, a file of it is missing or has another
    length, or its content cannot be read as a model; other errors (access, a failing store) are the caller's."""
    names = _published(path)
    if not names:
        raise BrokenArtefacts(f"no artefacts in {path}")
    folder = f"{path}/versions/{names[-1].split('-', 1)[1]}"
    fs, meta = _files(f"{folder}/meta.json")
    if not fs.exists(meta):
        raise BrokenArtefacts(f"{folder} is incomplete")
    try:
        doc = json.loads(_read_text(f"{folder}/meta.json"))
        vocab, listed = Vocabulary.from_dict(doc["vocab"]), doc["files"]
    except (ValueError, KeyError, TypeError) as e:
        raise BrokenArtefacts(f"{folder}: {e}") from e
    if not fs.exists(_files(f"{folder}/model")[1]) or _listing(f"{folder}/model") != listed:
        raise BrokenArtefacts(f"{folder}: files are missing or changed")
    try:
        model = PipelineModel.load(f"{folder}/model") if doc["kind"] == "pipeline" \
            else ht.load_model(_active_spark(), f"{folder}/model")
    except (ValueError, KeyError, TypeError, AnalysisException) as e:
        raise BrokenArtefacts(f"{folder}: {e}") from e
    return model, vocab, doc["meta"]


def drop_old_versions(path: str) -> int:
    """Delete the versions that are not current (of readers none may still hold one); how many."""
    fs, versions = _files(f"{path}/versions")
    names = _published(path)
    for name in names[:-1]:
        fs.delete(_files(f"{path}/{PUBLISHED}/{name}")[1], False)
    old = [s.getPath() for s in fs.listStatus(versions) if s.getPath().getName() != names[-1].split("-", 1)[1]]
    for p in old:
        fs.delete(p, True)
    return len(old)
