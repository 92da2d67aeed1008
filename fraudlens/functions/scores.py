"""Score-derived column expressions: pseudo-scores, verdict, risk band."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudlens.schema import RISK_BAND_EDGES, RISK_BAND_LABELS


def pseudo_probabilities(df: DataFrame) -> DataFrame:
    """Deterministic class probabilities computed from columns (oracle-reproducible)."""
    s10k = F.col("s10k")
    return df.withColumns({
        "p_fraud": s10k.cast("double") / 10000,
        "p_suspect": ((10000 - s10k) * F.col("k")).cast("double") / 1000000,
        "p_normal": ((10000 - s10k) * (100 - F.col("k"))).cast("double") / 1000000,
    })


def verdict(p_fraud: Column, p_normal: Column, p_suspect: Column, threshold) -> Column:
    """Fraude when p_fraud >= t, else the more probable of Normal/Suspect (tie -> Normal)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (F.when(p_fraud >= t, F.lit("Fraude"))
            .when(p_normal >= p_suspect, F.lit("Normal"))
            .otherwise(F.lit("Suspect")))


def risk_band(p_fraud: Column) -> Column:
    """Gauge band of a fraud probability: [0,33) [33,66) [66,100] percent."""
    pct = p_fraud * 100
    lo, hi = RISK_BAND_EDGES
    return (F.when(pct.isNull(), F.lit(None).cast("string"))
            .when(pct < lo, F.lit(RISK_BAND_LABELS[0]))
            .when(pct < hi, F.lit(RISK_BAND_LABELS[1]))
            .otherwise(F.lit(RISK_BAND_LABELS[2])))
