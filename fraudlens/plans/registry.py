"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (through the ``transactions`` adapter) and
runs over the whole tables; the matching DuckDB oracle lives in
:mod:`fraudlens.plans.oracle` under the same key.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.functions.columns import plain_number, r6, tolerant_timestamp
from fraudlens.functions.scores import risk_band, verdict
from fraudlens.operators import eda
from fraudlens.operators import features as feats
from fraudlens.operators import journal as jr
from fraudlens.operators import metrics as mt
from fraudlens.operators import rollup
from fraudlens.operators import split as sp
from fraudlens.operators.eda import TX_COLUMNS, FilterSpec
from fraudlens.schema import JOURNAL_SCHEMA, LABEL_ORDER, NUMERIC_FEATURES, RAW_TO_COLUMN
from fraudlens.session import files_identity, scratch_path, session_key, written_once
from fraudlens.sources import files
from fraudlens.sources.tables import scored, transactions
from fraudlens.streaming import jobs as st

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Fixed parameters of the registered filter queries (mirrored in the oracle SQL).
DEFAULT_FILTER = FilterSpec(date_from=date(2024, 1, 5), date_to=date(2024, 1, 25), amount_min=5.0,
                            amount_max=400.0, tx_types=["click", "purchase", "view"],
                            targets=["Fraude", "Suspect", "Normal"])
ROLLUP_FILTER = FilterSpec(date_from=date(2024, 1, 5), date_to=date(2024, 1, 20), tx_types=["click", "purchase", "view"],
                           targets=["Fraude", "Suspect", "Normal"])


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _tx(spark, sf_dir):
    return transactions(spark, sf_dir)


# ----------------------------------------------------------------------------- EDA
@query("kpis")
def q_kpis(spark, sf_dir):
    return eda.kpis(_tx(spark, sf_dir))


@query("dashboard_kpis")
def q_dashboard_kpis(spark, sf_dir):
    return eda.dashboard_kpis(_tx(spark, sf_dir))


@query("target_distribution")
def q_target_distribution(spark, sf_dir):
    return eda.target_distribution(_tx(spark, sf_dir))


@query("target_share_pie")
def q_target_share_pie(spark, sf_dir):
    return eda.target_share_pie(_tx(spark, sf_dir))


@query("top_locations")
def q_top_locations(spark, sf_dir):
    return eda.top_locations(_tx(spark, sf_dir), 15)


@query("location_status_rate")
def q_location_status_rate(spark, sf_dir):
    return eda.location_status_rate(_tx(spark, sf_dir), 10)


@query("location_type_volume")
def q_location_type_volume(spark, sf_dir):
    return eda.location_type_volume(_tx(spark, sf_dir), 10)


@query("location_type_rollup")
def q_location_type_rollup(spark, sf_dir):
    return eda.location_type_rollup(_tx(spark, sf_dir), 10)


@query("status_by_type")
def q_status_by_type(spark, sf_dir):
    return eda.status_by_type(_tx(spark, sf_dir))


@query("target_share_by_type")
def q_target_share_by_type(spark, sf_dir):
    return eda.target_share_by(_tx(spark, sf_dir), "tx_type")


@query("target_share_by_op_status")
def q_target_share_by_op_status(spark, sf_dir):
    return eda.target_share_by(_tx(spark, sf_dir), "op_status")


@query("status_rate_by_hour")
def q_status_rate_by_hour(spark, sf_dir):
    return eda.status_rate_by_hour(_tx(spark, sf_dir))


@query("status_rate_by_weekday")
def q_status_rate_by_weekday(spark, sf_dir):
    return eda.status_rate_by_weekday(_tx(spark, sf_dir))


@query("daily_trend")
def q_daily_trend(spark, sf_dir):
    return eda.daily_trend(_tx(spark, sf_dir))


@query("correlation_matrix")
def q_correlation_matrix(spark, sf_dir):
    return eda.correlation_matrix(_tx(spark, sf_dir))


@query("data_quality_profile")
def q_data_quality_profile(spark, sf_dir):
    return eda.data_quality_profile(_tx(spark, sf_dir))


@query("null_counts_by_column")
def q_null_counts_by_column(spark, sf_dir):
    return eda.null_counts_by_column(_tx(spark, sf_dir))


@query("duplicate_rows")
def q_duplicate_rows(spark, sf_dir):
    return eda.duplicate_rows(_tx(spark, sf_dir))


@query("describe_amount")
def q_describe_amount(spark, sf_dir):
    return eda.describe(_tx(spark, sf_dir), "amount")


@query("value_frequency_top30")
def q_value_frequency_top30(spark, sf_dir):
    return eda.value_frequency(_tx(spark, sf_dir), 30)


@query("value_frequency_all")
def q_value_frequency_all(spark, sf_dir):
    return eda.value_frequency(_tx(spark, sf_dir), None)


@query("amount_histogram")
def q_amount_histogram(spark, sf_dir):
    return eda.amount_histogram(_tx(spark, sf_dir), 20)


@query("amount_box_by_target")
def q_amount_box_by_target(spark, sf_dir):
    return eda.amount_box_by_target(_tx(spark, sf_dir))


@query("filtered_transactions")
def q_filtered_transactions(spark, sf_dir):
    return eda.filtered_transactions(_tx(spark, sf_dir), DEFAULT_FILTER).select(*TX_COLUMNS)


@query("filter_summary")
def q_filter_summary(spark, sf_dir):
    return eda.filter_summary(_tx(spark, sf_dir), DEFAULT_FILTER)


@query("filter_domains")
def q_filter_domains(spark, sf_dir):
    return eda.filter_domains(_tx(spark, sf_dir))


@query("filter_bounds")
def q_filter_bounds(spark, sf_dir):
    return eda.filter_bounds(_tx(spark, sf_dir))


@query("preview20")
def q_preview20(spark, sf_dir):
    return eda.preview(_tx(spark, sf_dir), 20).select(*TX_COLUMNS)


# ----------------------------------------------------------------------------- features


# Fixed parameters mirrored in the oracle SQL.
NEW_TX_CUTOFF = "2024-01-25 00:00:00"     # history before, "new" transactions from
JOURNAL_CUTOFF = "2024-01-15 00:00:00"    # between the two scoring runs of journal_roundtrip
SCORED_AT = ("2024-02-01 08:00:00", "2024-02-02 08:00:00")
THRESHOLD = 0.5
JOURNAL_STATUSES = ["Fraude", "Suspect"]


@query("features_base")
def q_features_base(spark, sf_dir):
    f = feats.base_features(_tx(spark, sf_dir))
    return f.select("operation_id", "location", "heure", "jour_semaine", "est_weekend", "est_nuit",
                    r6(F.col("log_montant")).alias("log_montant"))


def _raw_dates(tx):
    n = F.col("op_num")
    raw = (F.when(n % 17 == 0, F.lit("garbage"))
           .when(n % 23 == 0, F.lit(None).cast("string"))
           .when(n % 5 == 1, F.date_format("tx_ts", "dd/MM/yyyy HH:mm:ss"))
           .otherwise(F.date_format("tx_ts", "yyyy-MM-dd HH:mm:ss")))
    return tx.select("operation_id", raw.alias("ts_raw"))


@query("date_parse")
def q_date_parse(spark, sf_dir):
    d = _raw_dates(_tx(spark, sf_dir)).withColumn("tx_ts", tolerant_timestamp(F.col("ts_raw")))
    f = feats.base_features(d.withColumns({"location": F.lit(None).cast("string"),
                                           "amount": F.lit(None).cast("double")}))
    return f.select("operation_id", "ts_raw", "tx_ts", "heure", "jour_semaine", "est_weekend", "est_nuit")


@query("client_tx_count")
def q_client_tx_count(spark, sf_dir):
    return feats.with_client_tx_count(_tx(spark, sf_dir)).select("operation_id", "client_id", "nb_transactions_client")


@query("location_grouping")
def q_location_grouping(spark, sf_dir):
    f = feats.base_features(_tx(spark, sf_dir))
    return feats.group_locations(f, feats.top_location_frame(f)).select("operation_id", "location", "location_grp")


@query("one_hot_features")
def q_one_hot_features(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    vocab = feats.fit_vocabulary(tx)
    return feats.one_hot_long(feats.group_locations(feats.base_features(tx), vocab.top_locations), vocab)


@query("label_encode")
def q_label_encode(spark, sf_dir):
    from pyspark.ml.feature import IndexToString, StringIndexerModel
    tx = _tx(spark, sf_dir).select("operation_id", "target")
    enc = StringIndexerModel.from_labels(LABEL_ORDER, inputCol="target", outputCol="__label", handleInvalid="error")
    dec = IndexToString(inputCol="__label", outputCol="decoded", labels=LABEL_ORDER)
    out = dec.transform(enc.transform(tx))
    return out.select("operation_id", "target", F.col("__label").cast("int").alias("label"), "decoded")


@query("score_features_new_tx")
def q_score_features_new_tx(spark, sf_dir):
    tx = _tx(spark, sf_dir)
    cut = F.lit(NEW_TX_CUTOFF).cast("timestamp")
    history = feats.base_features(tx.where(F.col("tx_ts") < cut))
    new = feats.base_features(tx.where(F.col("tx_ts") >= cut))
    new = feats.group_locations(new, feats.top_location_frame(history))
    new = feats.with_client_tx_count(new, history=history, default=1)
    return new.select("operation_id", "location_grp", "nb_transactions_client", "heure", "jour_semaine",
                      "est_weekend", "est_nuit", r6(F.col("log_montant")).alias("log_montant"))


@query("make_ts")
def q_make_ts(spark, sf_dir):
    tx = _tx(spark, sf_dir).select("operation_id", F.to_date("tx_ts").alias("jour"),
                                   F.hour("tx_ts").alias("h"), F.minute("tx_ts").alias("m"),
                                   F.second("tx_ts").alias("s"))
    return tx.select("operation_id", "jour",
                     F.make_timestamp(F.year("jour"), F.month("jour"), F.dayofmonth("jour"), F.col("h"), F.col("m"),
                                      F.col("s")).alias("tx_ts_combine"))


@query("ts_format")
def q_ts_format(spark, sf_dir):
    return _tx(spark, sf_dir).select("operation_id",
                                     F.date_format("tx_ts", "yyyy-MM-dd HH:mm:ss").alias("horodatage_txt"),
                                     F.date_format("tx_ts", "dd/MM/yy").alias("periode"))


@query("tx_json")
def q_tx_json(spark, sf_dir):
    f = feats.with_client_tx_count(_tx(spark, sf_dir))

    def s(c):
        return F.coalesce(c.cast("string"), F.lit("None"))
    st = F.struct(s(F.col("tx_type")).alias("tx_type"), s(F.col("op_status")).alias("op_status"),
                  s(F.col("location")).alias("location"),
                  s(F.date_format("tx_ts", "yyyy-MM-dd HH:mm:ss")).alias("date"),
                  s(plain_number(F.col("amount"))).alias("amount"),
                  s(F.col("nb_transactions_client")).alias("nb_transactions_client"))
    return f.select("operation_id", F.to_json(st).alias("tx_json"))


# ----------------------------------------------------------------------------- scores & metrics
def _scored(spark, sf_dir):
    return scored(spark, sf_dir)


def _predicted(spark, sf_dir):
    sc = _scored(spark, sf_dir)
    return sc.withColumn("predicted_status", verdict(F.col("p_fraud"), F.col("p_normal"), F.col("p_suspect"), THRESHOLD))


@query("verdict")
def q_verdict(spark, sf_dir):
    return _predicted(spark, sf_dir).select("operation_id", "target", r6(F.col("p_fraud")).alias("p_fraud"),
                                            r6(F.col("p_normal")).alias("p_normal"),
                                            r6(F.col("p_suspect")).alias("p_suspect"), "predicted_status")


@query("risk_band")
def q_risk_band(spark, sf_dir):
    return _scored(spark, sf_dir).select("operation_id", r6(F.col("p_fraud")).alias("p_fraud"),
                                         risk_band(F.col("p_fraud")).alias("bande"))


@query("confusion_matrix")
def q_confusion_matrix(spark, sf_dir):
    return mt.confusion_matrix(_predicted(spark, sf_dir))


@query("classification_report")
def q_classification_report(spark, sf_dir):
    return mt.classification_report(_predicted(spark, sf_dir))


@query("model_metrics")
def q_model_metrics(spark, sf_dir):
    return mt.model_metrics(_predicted(spark, sf_dir))


def _verdicts_at(*thresholds: float) -> dict:
    return {f"seuil_{t}": verdict(F.col("p_fraud"), F.col("p_normal"), F.col("p_suspect"), t) for t in thresholds}


@query("comparison_all")
def q_comparison_all(spark, sf_dir):
    """Verdicts at five thresholds compared like models; no subset chosen shows them all."""
    return mt.comparison_view(mt.compare_verdicts(_scored(spark, sf_dir), _verdicts_at(0.2, 0.35, 0.5, 0.65, 0.8)), [])


@query("comparison_subset")
def q_comparison_subset(spark, sf_dir):
    """The same comparison with two of the candidates chosen."""
    table = mt.compare_verdicts(_scored(spark, sf_dir), _verdicts_at(0.2, 0.35, 0.5, 0.65, 0.8))
    return mt.comparison_view(table, ["seuil_0.35", "seuil_0.8"])


@query("threshold_metrics")
def q_threshold_metrics(spark, sf_dir):
    return mt.threshold_metrics(_scored(spark, sf_dir), THRESHOLD)


@query("threshold_confusion")
def q_threshold_confusion(spark, sf_dir):
    return mt.threshold_confusion(_scored(spark, sf_dir), THRESHOLD)


@query("pr_curve")
def q_pr_curve(spark, sf_dir):
    return mt.pr_curve(_scored(spark, sf_dir))


@query("roc_curve")
def q_roc_curve(spark, sf_dir):
    return mt.roc_curve(_scored(spark, sf_dir))


@query("roc_corners")
def q_roc_corners(spark, sf_dir):
    return mt.roc_corners(_scored(spark, sf_dir))


@query("top_values_high_cardinality")
def q_top_values_high_cardinality(spark, sf_dir):
    """The explorer's top 30 of the columns that it leaves out for their cardinality."""
    from fraudlens.operators.selection import top_values
    return top_values(_tx(spark, sf_dir), ["account_no", "operation_id"])


def _rollup(spark, sf_dir):
    return written_once(rollup.build(_tx(spark, sf_dir)), "rollup")


@query("rollup_kpis")
def q_rollup_kpis(spark, sf_dir):
    """KPIs of a filtered view from the roll-up; whether the estimate of distinct clients is within three errors."""
    view = rollup.selected(_rollup(spark, sf_dir), ROLLUP_FILTER)
    exact = eda.filtered_transactions(_tx(spark, sf_dir), ROLLUP_FILTER).agg(F.countDistinct("client_id").alias("c"))
    near = F.abs(F.col("clients_estimes") - F.col("c")) <= F.greatest(F.lit(1.0), 3 * 1.04 / 64 * F.col("c"))
    return rollup.kpis(view).join(F.broadcast(exact)).withColumn("clients_dans_erreur", near).drop("clients_estimes", "c")


@query("rollup_quartiles")
def q_rollup_quartiles(spark, sf_dir):
    """Quartiles of the amount by target, from merged sketches."""
    return rollup.quantiles(_rollup(spark, sf_dir), [0.25, 0.5, 0.75], ["target"])


@query("roc_auc")
def q_roc_auc(spark, sf_dir):
    return mt.roc_auc(_scored(spark, sf_dir))


@query("best_f1_threshold")
def q_best_f1_threshold(spark, sf_dir):
    return mt.best_f1_threshold(_scored(spark, sf_dir))


# ----------------------------------------------------------------------------- split, weights, scaling
def _split(spark, sf_dir):
    return sp.stratified_split(_tx(spark, sf_dir), classes=LABEL_ORDER)


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select("operation_id", "target", "is_test")


@query("cv_folds")
def q_cv_folds(spark, sf_dir):
    """Class-stratified folds of the train rows."""
    # the folds scan the train rows four times: the split before them is computed once
    train = written_once(_split(spark, sf_dir).where(~F.col("is_test")), "train_rows")
    return sp.stratified_folds(train).select("operation_id", "target", "fold")


@query("wide_feature_matrix")
def q_wide_feature_matrix(spark, sf_dir):
    """The model's feature matrix (numbers and 0/1 columns in the fitted order), a row for each of its cells."""
    feat, vocab = feats.enrich(_tx(spark, sf_dir))
    cols = vocab.feature_columns()
    fm = feats.feature_matrix(feat, vocab, keep=["operation_id"])
    fm = fm.select("operation_id", *[r6(F.col(f"`{c}`").cast("double")).alias(c) for c in cols])
    return fm.unpivot(["operation_id"], [F.col(f"`{c}`") for c in cols], "feature", "valeur")


@query("class_weights")
def q_class_weights(spark, sf_dir):
    return sp.class_weights(_split(spark, sf_dir).where(~F.col("is_test")))


@query("contamination_rate")
def q_contamination_rate(spark, sf_dir):
    return sp.contamination_rate(_split(spark, sf_dir).where(~F.col("is_test")))


@query("standardized_features")
def q_standardized_features(spark, sf_dir):
    from fraudlens.operators.models import apply_scaler, fit_scaler
    tx = sp.stratified_split(_tx(spark, sf_dir), classes=LABEL_ORDER)
    f = feats.with_client_tx_count(feats.base_features(tx), history=_tx(spark, sf_dir))
    # the split feature frame feeds the fit and the transform: computed once
    f = written_once(f.select("operation_id", "is_test", *NUMERIC_FEATURES), "split_features")
    scaler = fit_scaler(f.where(~F.col("is_test")), NUMERIC_FEATURES)
    z = apply_scaler(f, scaler)
    return z.select("operation_id", *[r6(F.col(c)).alias(c) for c in NUMERIC_FEATURES])


# ----------------------------------------------------------------------------- journal & runs
def _journal(spark, sf_dir):
    return jr.journal_from_scored(_scored(spark, sf_dir), THRESHOLD)


JOURNAL_COLUMNS = ["scored_at", "operation_id", "tx_type", "op_status", "location", "amount", "threshold",
                   "predicted_status", "p_fraude", "p_normal", "p_suspect"]


@query("journal_summary")
def q_journal_summary(spark, sf_dir):
    return jr.journal_summary(_journal(spark, sf_dir), JOURNAL_STATUSES)


@query("journal_filtered")
def q_journal_filtered(spark, sf_dir):
    return jr.journal_filtered(_journal(spark, sf_dir), JOURNAL_STATUSES).select(*JOURNAL_COLUMNS)


@query("journal_roundtrip")
def q_journal_roundtrip(spark, sf_dir):
    """Two scoring runs append to one journal, which is loaded again."""
    path = scratch_path(spark, "journal")
    sc = feats.with_client_tx_count(_scored(spark, sf_dir))
    early = F.coalesce(F.col("tx_ts") < F.lit(JOURNAL_CUTOFF).cast("timestamp"), F.lit(False))
    for at, part in zip(SCORED_AT, (early, ~early)):
        files.append_journal(jr.scoring_run(sc.where(part), THRESHOLD, F.lit(at).cast("timestamp")), path)
    return files.load_journal(spark, path).select(*[f.name for f in JOURNAL_SCHEMA.fields])


def _raw_csv(spark, sf_dir):
    """The transactions in the reference's file format, with missing and unreadable values."""
    n = F.col("op_num")
    tx = _tx(spark, sf_dir)
    text = {
        "Montant": F.when(n % 13 == 0, F.lit("NaN")).when(n % 17 == 0, F.lit("NA"))
        .when(n % 29 == 0, F.lit("abc")).otherwise(F.col("amount").cast("string")),
        "Date": F.when(n % 19 == 0, F.lit("garbage")).otherwise(F.date_format("tx_ts", "yyyy-MM-dd HH:mm:ss")),
    }
    return tx.select(*[text.get(c, F.col(name).cast("string")).alias(c) for c, name in RAW_TO_COLUMN.items()])


def _csv_roundtrip(spark, sf_dir, sep):
    path = scratch_path(spark, "csv")
    files.export_csv(_raw_csv(spark, sf_dir), path, sep)
    return files.read_transactions_csv(spark, path)


@query("csv_roundtrip_semicolon")
def q_csv_roundtrip_semicolon(spark, sf_dir):
    return _csv_roundtrip(spark, sf_dir, ";")


@query("csv_roundtrip_comma")
def q_csv_roundtrip_comma(spark, sf_dir):
    return _csv_roundtrip(spark, sf_dir, ",")


@query("csv_quality")
def q_csv_quality(spark, sf_dir):
    path = scratch_path(spark, "csv")
    files.export_csv(_raw_csv(spark, sf_dir), path, ";")
    return files.csv_quality(spark, path)


@query("export_csv_roundtrip")
def q_export_csv_roundtrip(spark, sf_dir):
    """The filtered view, exported and read again."""
    path = scratch_path(spark, "export")
    tx = eda.filtered_transactions(_tx(spark, sf_dir), DEFAULT_FILTER).select(*TX_COLUMNS)
    files.export_csv(tx, path)
    return spark.read.schema(tx.schema).option("header", True) \
        .option("timestampFormat", files.EXPORT_TS_FORMAT).csv(path)


@query("runs_roundtrip")
def q_runs_roundtrip(spark, sf_dir):
    """The runs appended to the run journal, loaded again; figures a run does not have are null."""
    path = scratch_path(spark, "runs")
    files.append_run(jr.daily_runs(_journal(spark, sf_dir)), path)
    return files.load_runs(spark, path)


@query("column_types")
def q_column_types(spark, sf_dir):
    return eda.column_types(_tx(spark, sf_dir))


@query("run_history")
def q_run_history(spark, sf_dir):
    return jr.run_history(jr.daily_runs(_journal(spark, sf_dir)))


@query("run_deltas")
def q_run_deltas(spark, sf_dir):
    return jr.run_deltas(jr.daily_runs(_journal(spark, sf_dir)))


# ----------------------------------------------------------------------------- streaming


@query("streaming_scoring")
def q_streaming_scoring(spark, sf_dir):
    return st.streaming_scoring(spark, sf_dir, THRESHOLD)


@query("stream_static_client_count")
def q_stream_static_client_count(spark, sf_dir):
    return st.stream_static_client_count(spark, sf_dir)


@query("streaming_journal_kpis")
def q_streaming_journal_kpis(spark, sf_dir):
    return st.streaming_journal_kpis(spark, sf_dir, THRESHOLD)


@query("streaming_daily_trend")
def q_streaming_daily_trend(spark, sf_dir):
    return st.streaming_daily_trend(spark, sf_dir)


@query("streaming_journal")
def q_streaming_journal(spark, sf_dir):
    """The journal that a stream wrote; when it was scored is told by a flag."""
    j = st.streaming_journal(spark, sf_dir, JOURNAL_CUTOFF, THRESHOLD)
    now = F.col("scored_at").between(F.current_timestamp() - F.expr("interval 1 day"), F.current_timestamp())
    return j.select(*[f.name for f in JOURNAL_SCHEMA.fields if f.name != "scored_at"], now.alias("scored_now"))


@query("streaming_dedup")
def q_streaming_dedup(spark, sf_dir):
    return st.streaming_dedup(spark, sf_dir)


# ----------------------------------------------------------------------------- machine learning
# Fitted artefacts are small driver objects; they are cached per session and state
# of the input files, so the comparison, importance and scoring queries reuse one
# training, and changed tables are trained on again.
_ML_CACHE: dict = {}


def _input_key(spark, sf_dir):
    tables = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("events", "customer", "nation")]
    return session_key(spark), files_identity(spark, *tables)


def _training(spark, sf_dir):
    from fraudlens.operators.models import prepare_training
    key = (*_input_key(spark, sf_dir), "data")
    if key not in _ML_CACHE:
        _ML_CACHE[key] = prepare_training(_tx(spark, sf_dir))
    return _ML_CACHE[key]


# Models whose fitted object stays cached (small; used for scoring and
# importances). The forest and boosting models are released once their test
# predictions are written: a deep 100-tree forest alone can take a large share
# of a small executor heap.
_KEEP_MODELS = {"logistic_regression", "decision_tree"}


def _fitted(spark, sf_dir, name):
    from fraudlens.operators.models import fit_model
    key = (*_input_key(spark, sf_dir), name)
    if key in _ML_CACHE:
        return _ML_CACHE[key]
    model = fit_model(_training(spark, sf_dir), name)
    if name in _KEEP_MODELS:
        _ML_CACHE[key] = model
    return model


def _predictions_table(spark, sf_dir, name):
    """Test-row probabilities and arg-max class of a model, written once to the
    shared folder and read back (lineage cut, model object released)."""
    import gc
    from fraudlens.operators.models import class_probabilities
    key = (*_input_key(spark, sf_dir), "pred", name)
    if key not in _ML_CACHE:
        d = _training(spark, sf_dir)
        model = _fitted(spark, sf_dir, name)
        p = class_probabilities(model, d.test).select("operation_id", "target", "prediction_status",
                                                      "p_fraude", "p_normal", "p_suspect")
        _ML_CACHE[key] = st.static_table(p, f"predictions_{name}")
        del model
        gc.collect()
    return _ML_CACHE[key]


def _test_predictions(spark, sf_dir, name):
    p = _predictions_table(spark, sf_dir, name)
    return p.select("operation_id", "target", "prediction_status", r6(F.col("p_fraude")).alias("p_fraude"),
                    r6(F.col("p_normal")).alias("p_normal"), r6(F.col("p_suspect")).alias("p_suspect"))


def _comparison_rows(spark, sf_dir):
    """Unweighted test metrics of every compared model, in fit order (one small row each)."""
    from fraudlens.operators.models import MODEL_NAMES
    rows = []
    for order, name in enumerate(MODEL_NAMES):
        m = mt.model_metrics(_predictions_table(spark, sf_dir, name), "target", "prediction_status").collect()[0]
        rows.append({"model": name, "fit_order": order, **m.asDict()})
    return rows


@query("train_lr")
def q_train_lr(spark, sf_dir):
    return _test_predictions(spark, sf_dir, "logistic_regression")


@query("train_dt")
def q_train_dt(spark, sf_dir):
    return _test_predictions(spark, sf_dir, "decision_tree")


@query("train_rf")
def q_train_rf(spark, sf_dir):
    return _test_predictions(spark, sf_dir, "random_forest")


@query("train_gbt_ovr")
def q_train_gbt_ovr(spark, sf_dir):
    """One binary boosting model a class, renormalised."""
    from fraudlens.operators.models import OVR_BOOSTING
    return _test_predictions(spark, sf_dir, OVR_BOOSTING)


@query("train_gbt_multinomial")
def q_train_gbt_multinomial(spark, sf_dir):
    """Softmax boosting: one tree for every class and round."""
    return _test_predictions(spark, sf_dir, "gradient_boosting")


@query("train_dt_hist")
def q_train_dt_hist(spark, sf_dir):
    """The nodes of the decision tree, which has no limit of depth: path, split, rows of each class."""
    m = _fitted(spark, sf_dir, "decision_tree")
    names = F.array(*[F.lit(c) for c in m.bins.columns])
    return m.nodes.select("node", F.length("node").alias("depth"), F.get(names, F.col("feature")).alias("feature"), "bin",
                          *[F.col("counts")[i].alias(f"n_{c.lower()}") for i, c in enumerate(LABEL_ORDER)])


@query("tree_grid_search")
def q_tree_grid_search(spark, sf_dir):
    """The decision tree's whole grid: three fits a fold, the other axes are cuts of these trees."""
    from fraudlens.operators.models import search_table
    return search_table(_training(spark, sf_dir), "decision_tree")[1]


@query("model_comparison")
def q_model_comparison(spark, sf_dir):
    """The four models, ranked; metrics also in percent, with the number of models."""
    from fraudlens.operators.models import MODEL_NAMES
    parts = []
    for order, name in enumerate(MODEL_NAMES):
        m = mt.model_metrics(_predictions_table(spark, sf_dir, name), "target", "prediction_status")
        parts.append(m.select(F.lit(name).alias("model"), F.lit(order).alias("fit_order"), "*"))
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return mt.comparison_view(table)


@query("grid_search")
def q_grid_search(spark, sf_dir):
    """The whole grid of the model that wins the comparison."""
    from fraudlens.operators.models import RANK_DECIMALS, search_table
    rows = _comparison_rows(spark, sf_dir)
    winner = min(rows, key=lambda r: (-round(r["recall_fraude"], RANK_DECIMALS), r["fit_order"]))["model"]
    table = search_table(_training(spark, sf_dir), winner)[1]
    return table.select(F.lit(winner).alias("model"), "*")


@query("feature_importance")
def q_feature_importance(spark, sf_dir):
    from fraudlens.operators.models import feature_importances
    d = _training(spark, sf_dir)
    return feature_importances(_fitted(spark, sf_dir, "decision_tree"), d.feature_columns, 12)


@query("class_probabilities")
def q_class_probabilities(spark, sf_dir):
    """Per test row, the three class probabilities (percent) sorted desc with
    their rank; sorted inside each row (no window, so copies of one id are
    never gathered)."""
    p = _test_predictions(spark, sf_dir, "decision_tree")
    items = F.array(*[F.struct((-F.col(c)).alias("k"), F.lit(n).alias("statut"), (F.col(c) * 100).alias("probabilite"))
                      for c, n in (("p_fraude", "Fraude"), ("p_normal", "Normal"), ("p_suspect", "Suspect"))])
    long = p.select("operation_id", F.posexplode(F.sort_array(items)).alias("__pos", "__it"))
    return long.select("operation_id", F.col("__it.statut").alias("statut"), F.col("__it.probabilite").alias("probabilite"),
                       (F.col("__pos") + 1).alias("rang"))


def _model_threshold(spark, sf_dir, name):
    """Best-F1 threshold of a fitted model's fraud probability on the test rows."""
    d = _training(spark, sf_dir)
    from fraudlens.operators.models import class_probabilities
    p = class_probabilities(_fitted(spark, sf_dir, name), d.test)
    row = mt.best_f1_threshold(p, score="p_fraude").collect()[0]  # one row
    return float(row["seuil"])


@query("model_best_threshold")
def q_model_best_threshold(spark, sf_dir):
    d = _training(spark, sf_dir)
    from fraudlens.operators.models import class_probabilities
    p = class_probabilities(_fitted(spark, sf_dir, "logistic_regression"), d.test)
    return mt.best_f1_threshold(p, score="p_fraude")


@query("batch_scoring")
def q_batch_scoring(spark, sf_dir):
    """Score every transaction with the fitted model and its calibrated threshold."""
    from fraudlens.operators.models import score_with_threshold
    name = "logistic_regression"
    d = _training(spark, sf_dir)
    t = _model_threshold(spark, sf_dir, name)
    feat, _ = feats.enrich(_tx(spark, sf_dir), vocab=d.vocab)
    fm = feats.feature_matrix(feat, d.vocab, keep=["operation_id", "target"])
    s = score_with_threshold(_fitted(spark, sf_dir, name), fm, t)
    return s.select("operation_id", "target", F.lit(t).alias("threshold"), "predicted_status",
                    r6(F.col("p_fraude")).alias("p_fraude"), r6(F.col("p_normal")).alias("p_normal"),
                    r6(F.col("p_suspect")).alias("p_suspect"))


@query("streaming_model_scoring")
def q_streaming_model_scoring(spark, sf_dir):
    """ST1 with the fitted model: stream -> same feature transform (fitted
    vocabulary, client counts from the static history, default 1) -> model ->
    verdict -> journal sink."""
    from fraudlens.operators.models import score_with_threshold
    name = "logistic_regression"
    d = _training(spark, sf_dir)
    t = _model_threshold(spark, sf_dir, name)
    stream = st.stream_transactions(spark, sf_dir)
    feat = feats.group_locations(feats.base_features(stream), d.vocab.top_locations)
    counts = st.static_table(eda.client_counts(_tx(spark, sf_dir)), "client_counts")
    feat = feat.join(counts, "client_id", "left").withColumn(
        "nb_transactions_client", F.coalesce(F.col("nb_transactions_client"), F.lit(1).cast("long")))
    fm = feats.feature_matrix(feat, d.vocab, keep=["operation_id", "tx_ts", "amount", "target"])
    s = score_with_threshold(_fitted(spark, sf_dir, name), fm, t)
    s = s.select(F.col("tx_ts").alias("scored_at"), "operation_id", "amount", "target", F.lit(t).alias("threshold"),
                 "predicted_status", (F.col("p_fraude") * 100).alias("p_fraude"),
                 (F.col("p_normal") * 100).alias("p_normal"), (F.col("p_suspect") * 100).alias("p_suspect"))
    return st.run_available(s, "model_scoring")


def _iforest(spark, sf_dir):
    from fraudlens.operators.iforest import fit_isolation_forest
    key = (*_input_key(spark, sf_dir), "iforest")
    if key not in _ML_CACHE:
        d = _training(spark, sf_dir)
        scaled = _scaled(d)
        contamination = sp.fraud_share(d.train).collect()[0][0]
        _ML_CACHE[key] = (fit_isolation_forest(scaled[0], d.feature_columns, contamination=contamination),
                          scaled, contamination)
    return _ML_CACHE[key]


def _scaled(d):
    """Train / test standardised with the train statistics (fit without labels)."""
    from fraudlens.operators.models import apply_scaler, fit_scaler
    sc = fit_scaler(d.train, d.feature_columns)
    return apply_scaler(d.train, sc), apply_scaler(d.test, sc)


@query("isolation_forest_scores")
def q_isolation_forest_scores(spark, sf_dir):
    from fraudlens.operators.iforest import flag_anomalies
    model, (train, test), _ = _iforest(spark, sf_dir)
    both = train.select("operation_id", "target", "is_test", *model.features).unionByName(
        test.select("operation_id", "target", "is_test", *model.features))
    return flag_anomalies(model, both).select("operation_id", "target", "is_test",
                                              r6(F.col("if_score")).alias("if_score"), "is_anomaly")


@query("isolation_forest_metrics")
def q_isolation_forest_metrics(spark, sf_dir):
    from fraudlens.operators.iforest import flag_anomalies
    model, (_, test), contamination = _iforest(spark, sf_dir)
    flagged = flag_anomalies(model, test).withColumn("__s", F.col("is_anomaly").cast("double"))
    m = mt.threshold_metrics(flagged, 0.5, score="__s")
    return m.select(F.lit(float(contamination)).alias("contamination"), "precision", "rappel", "f1",
                    "faux_negatifs", "faux_positifs")


@query("training_run")
def q_training_run(spark, sf_dir):
    """The whole training lifecycle, the winner tuned over its whole grid."""
    from fraudlens.plans.training import run_training
    out = scratch_path(spark, "training")
    return run_training(spark, _tx(spark, sf_dir), f"{out}/artefacts", f"{out}/runs",
                        data=_training(spark, sf_dir), comparison=_comparison_rows(spark, sf_dir))


# ----------------------------------------------------------------------------- composed / single-scan EDA
@query("target_crosstabs")
def q_target_crosstabs(spark, sf_dir):
    return eda.target_crosstabs(_tx(spark, sf_dir))


@query("filtered_kpis")
def q_filtered_kpis(spark, sf_dir):
    """KPIs of the filtered view (the EDA page computes every widget on it)."""
    return eda.kpis(eda.filtered_transactions(_tx(spark, sf_dir), DEFAULT_FILTER))


@query("filtered_location_status_rate")
def q_filtered_location_status_rate(spark, sf_dir):
    return eda.location_status_rate(eda.filtered_transactions(_tx(spark, sf_dir), DEFAULT_FILTER), 10)


@query("client_id_histogram")
def q_client_id_histogram(spark, sf_dir):
    return eda.amount_histogram(_tx(spark, sf_dir).withColumn("client_id", F.col("client_id").cast("double")),
                                20, col="client_id")


@query("ts_histogram")
def q_ts_histogram(spark, sf_dir):
    """Datetime column split by target, one bin per calendar day."""
    return (_tx(spark, sf_dir).where(F.col("tx_ts").isNotNull() & F.col("target").isNotNull())
            .groupBy(F.date_trunc("day", "tx_ts").alias("bin_debut"), "target")
            .agg(F.count(F.lit(1)).alias("nombre")))
