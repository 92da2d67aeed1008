"""Prediction journal and monitoring-run analytics.

The journal is an append-only table (one row per scored transaction). Runs are
evaluation snapshots; ``daily_runs`` derives one run per calendar day from a
scored journal so the run history grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions.columns import r6
from fraudlens.functions.scores import verdict
from fraudlens.schema import FRAUD


def journal_from_scored(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Journal rows: transaction, threshold used, verdict, class probabilities (%)."""
    return scored.select(
        F.col("tx_ts").alias("scored_at"), "operation_id", "tx_type", "op_status", "location", "tx_ts", "amount",
        "client_id", "target",
        F.lit(float(threshold)).alias("threshold"),
        verdict(F.col("p_fraud"), F.col("p_normal"), F.col("p_suspect"), threshold).alias("predicted_status"),
        r6(F.col("p_fraud") * 100).alias("p_fraude"), r6(F.col("p_normal") * 100).alias("p_normal"),
        r6(F.col("p_suspect") * 100).alias("p_suspect"))


def percent(p: Column) -> Column:
    """A probability in percent at two decimals (rounded from its decimal digits, half up)."""
    return F.round((p * 100).cast("decimal(12,6)"), 2).cast("double")


def scoring_run(scored: DataFrame, threshold: float = 0.5, scored_at: Column | None = None) -> DataFrame:
    """Journal rows of one scoring run of transactions with probabilities and
    ``nb_transactions_client``: when they were scored, the client's count, the
    verdict and the probabilities in percent. Batch jobs append them with
    ``append_journal``."""
    return scored.select(
        (F.current_timestamp() if scored_at is None else scored_at).alias("scored_at"), "operation_id", "tx_type",
        "op_status", "location", "tx_ts", "amount", F.col("nb_transactions_client").alias("client_tx_count"),
        F.lit(float(threshold)).alias("threshold"),
        verdict(F.col("p_fraud"), F.col("p_normal"), F.col("p_suspect"), threshold).alias("predicted_status"),
        percent(F.col("p_fraud")).alias("p_fraude"), percent(F.col("p_normal")).alias("p_normal"),
        percent(F.col("p_suspect")).alias("p_suspect"))


def journal_summary(journal: DataFrame, statuses: list[str]) -> DataFrame:
    """n, fraud verdicts and total amount, for the whole journal and for the
    status-filtered view, in one pass."""
    sel = F.coalesce(F.col("predicted_status").isin(statuses), F.lit(False)) if statuses else F.lit(False)
    fr = F.col("predicted_status") == FRAUD
    return journal.agg(
        F.count(F.lit(1)).alias("n_predictions"),
        F.count_if(F.coalesce(fr, F.lit(False))).alias("n_fraude"),
        r6(F.coalesce(F.sum("amount"), F.lit(0.0))).alias("montant_total"),
        F.count_if(sel).alias("n_predictions_filtre"),
        F.count_if(sel & F.coalesce(fr, F.lit(False))).alias("n_fraude_filtre"),
        r6(F.coalesce(F.sum(F.when(sel, F.col("amount"))), F.lit(0.0))).alias("montant_filtre"))


def journal_filtered(journal: DataFrame, statuses: list[str]) -> DataFrame:
    """Journal rows with a selected verdict, newest first."""
    return journal.where(F.col("predicted_status").isin(statuses)).orderBy(F.desc("scored_at"), F.asc("operation_id"))


def daily_runs(journal: DataFrame, model_name: str = "pseudo_score") -> DataFrame:
    """One evaluation run per calendar day: accuracy and fraud precision /
    recall / F1 of the journal verdicts against the known target."""
    y = F.col("target").eqNullSafe(FRAUD)
    p = F.col("predicted_status").eqNullSafe(FRAUD)
    g = (journal.where(F.col("scored_at").isNotNull())
         .groupBy(F.to_date("scored_at").alias("jour"))
         .agg(F.count(F.lit(1)).alias("n_test"),
              F.count_if(F.col("predicted_status").eqNullSafe(F.col("target"))).alias("__ok"),
              F.count_if(y & p).alias("__tp"), F.count_if(~y & p).alias("__fp"), F.count_if(y & ~p).alias("__fn"),
              F.max("threshold").alias("best_threshold_f1")))
    prec = F.coalesce(F.try_divide(F.col("__tp").cast("double"), (F.col("__tp") + F.col("__fp")).cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("__tp").cast("double"), (F.col("__tp") + F.col("__fn")).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide((2 * F.col("__tp")).cast("double"),
                                 (2 * F.col("__tp") + F.col("__fp") + F.col("__fn")).cast("double")), F.lit(0.0))
    return g.select(F.col("jour").cast("timestamp").alias("horodatage"), F.lit(model_name).alias("model_nom"),
                    r6(F.col("__ok") / F.col("n_test")).alias("accuracy"), r6(prec).alias("precision_fraude"),
                    r6(rec).alias("rappel_fraude"), r6(f1).alias("f1_fraude"), "best_threshold_f1", "n_test")


RUN_HISTORY_COLUMNS = ["horodatage", "model_nom", "accuracy", "rappel_fraude", "f1_fraude", "best_threshold_f1", "n_test",
                       "duree_entrainement_sec"]


def run_history(runs: DataFrame) -> DataFrame:
    """The runs, newest first; a run without a figure (monitoring runs have no training time) shows null."""
    cols = [F.col(c) if c in runs.columns else F.lit(None).cast("double").alias(c) for c in RUN_HISTORY_COLUMNS]
    return runs.select(*cols).orderBy(F.desc("horodatage"))


def run_deltas(runs: DataFrame, metrics=("accuracy", "rappel_fraude", "f1_fraude")) -> DataFrame:
    """Each run's change versus the previous run (the first run has no delta).
    The runs table holds one row per run, so the unpartitioned window is small."""
    w = Window.orderBy("horodatage")
    out = runs.select("horodatage", *metrics, *[F.lag(m).over(w).alias(f"__prev_{m}") for m in metrics])
    return out.where(F.col(f"__prev_{metrics[0]}").isNotNull() | F.lit(len(metrics) == 0)).select(
        "horodatage", *metrics, *[r6(F.col(m) - F.col(f"__prev_{m}")).alias(f"delta_{m}") for m in metrics])
