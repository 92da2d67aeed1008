"""Schemas, column names and fixed domain values."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the studied application's for identical results.
# Target classes in display order, and their label-encoder (alphabetical) order.
TARGET_CLASSES = ["Normal", "Suspect", "Fraude"]
LABEL_ORDER = ["Fraude", "Normal", "Suspect"]
FRAUD = "Fraude"
SUSPECT = "Suspect"
NORMAL = "Normal"
# Weekday names, Monday first.
WEEKDAY_NAMES = ["Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche"]
# Location spelling variants mapped to one canonical name.
LOCATION_VARIANTS = {"Saint-Louis": "Saint Louis"}
# Bucket for locations outside the fitted top list.
OTHER_LOCATION = "Autre"
# Number of locations kept by the rare-location grouping.
TOP_LOCATIONS = 15
# Generator vocabularies (synthetic transactions).
SYNTH_TX_TYPES = ["ATM", "Paiement en ligne", "Paiement électronique"]
SYNTH_OP_STATUSES = ["Validé", "Echoué", "En attente"]
SYNTH_LOCATIONS = ["Dakar", "Thiès", "Kaolack", "Saint Louis", "Tambacounda",
                   "Ziguinchor", "Louga", "Fatick", "Kolda", "Matam"]
# Raw CSV header names and our snake_case names (required ones first, in declared order).
RAW_TO_COLUMN = {
    "ID Clients": "client_id",
    "Numero de compte": "account_no",
    "Identifiant operation": "operation_id",
    "Type de transaction": "tx_type",
    "Status operation": "op_status",
    "Localisation": "location",
    "Date": "tx_ts",
    "Montant": "amount",
    "Target": "target",
}
REQUIRED_RAW_COLUMNS = ["ID Clients", "Type de transaction", "Status operation", "Localisation",
                        "Date", "Montant", "Target"]
# Columns excluded from the univariate explorer (high cardinality).
HIGH_CARDINALITY = {"operation_id", "account_no"}
UNIVARIATE_TOP = 30
# Categorical columns one-hot encoded, and numeric model features, in model order.
CATEGORICAL_FEATURES = ["tx_type", "op_status", "location_grp"]
NUMERIC_FEATURES = ["log_montant", "heure", "jour_semaine", "est_weekend", "est_nuit",
                    "nb_transactions_client"]
# Risk gauge bands on the fraud probability in percent: [0, 33) [33, 66) [66, 100],
# coloured like the Normal / Suspect / Fraude classes.
RISK_BAND_EDGES = [33.0, 66.0]
RISK_BAND_LABELS = ["Normal", "Suspect", "Fraude"]
# Columns of the run journal, in order.
RUNS_SCHEMA = T.StructType([
    T.StructField("horodatage", T.TimestampType()),
    T.StructField("model_nom", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision_fraude", T.DoubleType()),
    T.StructField("rappel_fraude", T.DoubleType()),
    T.StructField("f1_fraude", T.DoubleType()),
    T.StructField("rappel_macro", T.DoubleType()),
    T.StructField("f1_macro", T.DoubleType()),
    T.StructField("best_threshold_f1", T.DoubleType()),
    T.StructField("grid_search_best_params", T.StringType()),
    T.StructField("n_test", T.LongType()),
    T.StructField("duree_entrainement_sec", T.DoubleType()),
])
# ---------------------------------------------------------------------------

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("client_id", T.LongType()),
    T.StructField("account_no", T.LongType()),
    T.StructField("operation_id", T.StringType()),
    T.StructField("tx_type", T.StringType()),
    T.StructField("op_status", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("tx_ts", T.TimestampType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("target", T.StringType()),
])

# Raw CSV: everything read as text except numeric columns; dates are parsed
# tolerantly afterwards.
RAW_CSV_SCHEMA = T.StructType([
    T.StructField("ID Clients", T.LongType()),
    T.StructField("Numero de compte", T.LongType()),
    T.StructField("Identifiant operation", T.StringType()),
    T.StructField("Type de transaction", T.StringType()),
    T.StructField("Status operation", T.StringType()),
    T.StructField("Localisation", T.StringType()),
    T.StructField("Date", T.StringType()),
    T.StructField("Montant", T.DoubleType()),
    T.StructField("Target", T.StringType()),
])

JOURNAL_SCHEMA = T.StructType([
    T.StructField("scored_at", T.TimestampType()),
    T.StructField("operation_id", T.StringType()),
    T.StructField("tx_type", T.StringType()),
    T.StructField("op_status", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("tx_ts", T.TimestampType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("client_tx_count", T.LongType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("predicted_status", T.StringType()),
    T.StructField("p_fraude", T.DoubleType()),
    T.StructField("p_normal", T.DoubleType()),
    T.StructField("p_suspect", T.DoubleType()),
])
