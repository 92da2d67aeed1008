"""Scalar column expressions (all JVM-side, codegen-friendly; no Python UDFs).

Null rules follow the studied application: a null hour/weekday gives 0 for the
night/weekend flags, rates count null targets in the denominator, and a
negative amount gives a null log.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fraudlens.schema import FRAUD, LOCATION_VARIANTS, SUSPECT, WEEKDAY_NAMES

# Accepted timestamp layouts for tolerant parsing, tried in order.
DEFAULT_TS_FORMATS = ("yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd",
                      "yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
                      "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm", "dd/MM/yyyy HH:mm",
                      "dd/MM/yyyy")


def tolerant_timestamp(raw: Column, formats=DEFAULT_TS_FORMATS) -> Column:
    """Parse text to timestamp; unparseable text gives NULL (never an error)."""
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats])


def normalize_location(loc: Column) -> Column:
    out = loc
    for variant, canonical in LOCATION_VARIANTS.items():
        out = F.when(loc == variant, F.lit(canonical)).otherwise(out)
    return out


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def weekday_of(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def weekend_flag(weekday: Column) -> Column:
    return F.coalesce(weekday.isin(5, 6), F.lit(False)).cast("int")


def night_flag(hour: Column) -> Column:
    return F.coalesce((hour >= 22) | (hour < 6), F.lit(False)).cast("int")


def log_amount(amount: Column) -> Column:
    """log(1 + amount); NULL below -1 and at -1."""
    return F.when(amount > -1, F.log1p(amount))


def clipped_log_amount(amount: Column) -> Column:
    """log(1 + max(amount, 0)); a null amount stays null."""
    return F.log1p(F.when(amount < 0, F.lit(0.0)).otherwise(amount))


def is_fraud(target: Column) -> Column:
    """Null-safe indicator: a null target counts as 'not fraud'."""
    return target.eqNullSafe(FRAUD).cast("int")


def is_suspect_or_fraud(target: Column) -> Column:
    return F.coalesce(target.isin(SUSPECT, FRAUD), F.lit(False)).cast("int")


def weekday_label(weekday: Column) -> Column:
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.element_at(names, weekday + 1)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL on a zero denominator (no ANSI error)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def r6(c: Column) -> Column:
    """Round to 6 decimals: stabilises float results across engines."""
    return F.round(c, 6)


def plain_number(c: Column) -> Column:
    """A double as text without an exponent from 1e-4 up to 1e16 (shortest digits
    that give the number back, at least one after the point)."""
    digits = F.regexp_replace(c.cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    size = F.abs(c)
    return F.when(((size >= 1e7) & (size < 1e16)) | ((size >= 1e-4) & (size < 1e-3)), plain).otherwise(c.cast("string"))
