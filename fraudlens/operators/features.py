"""Feature engineering shared by batch training, batch scoring and streaming.

One transform for every path (the single-row path of the studied application
skipped the location normalisation; here it is always applied).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.functions.columns import (hour_of, log_amount, night_flag, normalize_location, weekday_of,
                                         weekend_flag)
from fraudlens.operators.eda import client_counts
from fraudlens.schema import CATEGORICAL_FEATURES, LABEL_ORDER, NUMERIC_FEATURES, OTHER_LOCATION, TOP_LOCATIONS
from fraudlens.session import written_once


def base_features(tx: DataFrame) -> DataFrame:
    """Normalised location, hour, weekday (Mon=0), weekend/night flags, log amount."""
    ts = F.col("tx_ts")
    return tx.withColumns({
        "location": normalize_location(F.col("location")),
        "heure": hour_of(ts),
        "jour_semaine": weekday_of(ts),
    }).withColumns({
        "est_weekend": weekend_flag(F.col("jour_semaine")),
        "est_nuit": night_flag(F.col("heure")),
        "log_montant": log_amount(F.col("amount")),
    })


def top_location_frame(tx: DataFrame, n: int = TOP_LOCATIONS) -> DataFrame:
    """The n most frequent (normalised) locations, ties by name: at most n rows."""
    return (tx.where(F.col("location").isNotNull()).groupBy("location").agg(F.count(F.lit(1)).alias("__n"))
            .orderBy(F.desc("__n"), F.asc("location")).limit(n).select("location"))


def group_locations(df: DataFrame, top: DataFrame | list[str]) -> DataFrame:
    """location_grp = location when in the top list, else 'Autre' (null -> 'Autre')."""
    if isinstance(top, list):
        in_top = F.col("location").isin(top) if top else F.lit(False)
        return df.withColumn("location_grp", F.when(F.coalesce(in_top, F.lit(False)), F.col("location"))
                             .otherwise(F.lit(OTHER_LOCATION)))
    # top has at most TOP_LOCATIONS rows (a limit), so the broadcast is bounded.
    t = top.select(F.col("location").alias("__top_loc"))
    j = df.join(F.broadcast(t), df["location"] == t["__top_loc"], "left")
    return j.withColumn("location_grp", F.when(F.col("__top_loc").isNotNull(), F.col("location"))
                        .otherwise(F.lit(OTHER_LOCATION))).drop("__top_loc")


def with_client_tx_count(df: DataFrame, history: DataFrame | None = None, default: int | None = None) -> DataFrame:
    """nb_transactions_client from ``history`` (default: df itself); a client
    absent from history gets ``default`` (NULL when None)."""
    counts = client_counts(history if history is not None else df)
    out = df.join(counts, "client_id", "left")
    if default is not None:
        out = out.withColumn("nb_transactions_client",
                             F.coalesce(F.col("nb_transactions_client"), F.lit(default).cast("long")))
    return out


@dataclass
class Vocabulary:
    """Fitted state of the feature transform (small lists, kept with the model)."""
    top_locations: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)

    def dropped_first(self) -> dict[str, list[str]]:
        """Levels kept as dummies: all but the alphabetically first of each column."""
        return {c: sorted(v)[1:] for c, v in self.levels.items()}

    def feature_columns(self) -> list[str]:
        cols = list(NUMERIC_FEATURES)
        for c in CATEGORICAL_FEATURES:
            cols += [dummy_name(c, v) for v in self.dropped_first().get(c, [])]
        return cols

    def to_dict(self) -> dict:
        return {"top_locations": self.top_locations, "levels": self.levels}

    @staticmethod
    def from_dict(d: dict) -> "Vocabulary":
        return Vocabulary(list(d["top_locations"]), {k: list(v) for k, v in d["levels"].items()})


def dummy_name(col: str, level: str) -> str:
    return f"{col}_{level}"


def fit_vocabulary(tx: DataFrame, nb_locations: int = TOP_LOCATIONS) -> Vocabulary:
    """Fit the top-location list and the categorical levels from one scan: a
    per-(column, value) count table (map-side combined, one row per distinct
    value) is cached, and the lists are read from it. The levels of the model's
    categorical columns reach the driver, as each of them is a model column."""
    feat = base_features(tx)
    raw_cols = [c for c in CATEGORICAL_FEATURES if c != "location_grp"] + ["location"]
    counts = written_once(feat.select(*raw_cols).unpivot([], raw_cols, "col", "level")
                          .groupBy("col", "level").agg(F.count(F.lit(1)).alias("n")), "levels")
    loc = counts.where(F.col("col") == "location")
    top_rows = (loc.where(F.col("level").isNotNull()).orderBy(F.desc("n"), F.asc("level"))
                .limit(nb_locations).collect())
    top = [r["level"] for r in top_rows]
    loc_total = loc.agg(F.sum("n")).collect()[0][0] or 0
    rows = counts.where((F.col("col") != "location") & F.col("level").isNotNull()).select("col", "level").collect()
    levels = {c: sorted(r["level"] for r in rows if r["col"] == c) for c in CATEGORICAL_FEATURES if c != "location_grp"}
    # grouped levels: the top locations, plus the fallback when any row falls outside them
    grp = list(top) + ([OTHER_LOCATION] if loc_total > sum(r["n"] for r in top_rows) else [])
    levels["location_grp"] = sorted(set(grp))
    return Vocabulary(top, {c: levels[c] for c in CATEGORICAL_FEATURES})


def enrich(tx: DataFrame, vocab: Vocabulary | None = None, nb_locations: int = TOP_LOCATIONS,
           history: DataFrame | None = None, default_count: int | None = None) -> tuple[DataFrame, Vocabulary]:
    """Raw transactions -> derived feature frame (+ fitted vocabulary)."""
    if vocab is None:
        vocab = fit_vocabulary(tx, nb_locations)
    feat = base_features(tx)
    feat = group_locations(feat, vocab.top_locations)
    feat = with_client_tx_count(feat, history, default_count)
    return feat, vocab


def one_hot_columns(vocab: Vocabulary) -> list[Column]:
    """Wide 0/1 dummies (null -> all zeros), aligned to the fitted vocabulary:
    unseen levels produce no column, missing levels are 0."""
    out = []
    for c, kept in vocab.dropped_first().items():
        for v in kept:
            out.append(F.col(c).eqNullSafe(v).cast("int").alias(dummy_name(c, v)))
    return out


def feature_matrix(feat: DataFrame, vocab: Vocabulary, keep: list[str] | None = None) -> DataFrame:
    """Select the model's feature columns in the fitted order (P15 alignment)."""
    keep = keep or []
    return feat.select(*keep, *[F.col(c) for c in NUMERIC_FEATURES], *one_hot_columns(vocab))


def one_hot_long(feat: DataFrame, vocab: Vocabulary, key: str = "operation_id") -> DataFrame:
    """Sparse (COO) one-hot of grouped features: (key, feature, 1) for each
    non-null level that is not the alphabetically first of its column."""
    long = feat.select(key, *CATEGORICAL_FEATURES).unpivot([key], CATEGORICAL_FEATURES, "col", "level")
    first = F.create_map(*[x for c in CATEGORICAL_FEATURES
                           for x in (F.lit(c), F.lit(min(vocab.levels[c], default=None)))])
    return (long.where(F.col("level") != F.try_element_at(first, F.col("col")))
            .select(key, F.concat(F.col("col"), F.lit("_"), F.col("level")).alias("feature"),
                    F.lit(1).alias("value")))


def label_index(target: Column) -> Column:
    """Alphabetical label code (Fraude=0, Normal=1, Suspect=2); unseen -> NULL."""
    m = F.create_map(*[x for i, c in enumerate(LABEL_ORDER) for x in (F.lit(c), F.lit(i))])
    return F.try_element_at(m, target)
