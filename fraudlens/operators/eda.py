"""Exploratory analytics over a transactions DataFrame (KPIs, cross-tabs,
distributions, correlations, profiles, filters).

Design rules: one scan per output where the semantics allow (conditional
aggregates instead of pivots and self-joins), top-N always taken from an
already aggregated table, domain completion by small fixed-vocabulary frames.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions.columns import (clipped_log_amount, hour_of, is_fraud, is_suspect_or_fraud,
                                         r6, safe_ratio, weekday_label, weekday_of, weekend_flag)
from fraudlens.operators.selection import order_statistics
from fraudlens.schema import (FRAUD, HIGH_CARDINALITY, NORMAL, SUSPECT, TARGET_CLASSES, TRANSACTION_SCHEMA,
                              UNIVARIATE_TOP)
from fraudlens.session import written_once

TX_COLUMNS = [f.name for f in TRANSACTION_SCHEMA.fields]


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def _class_counts(target: str = "target") -> list[Column]:
    return [_count_if(F.col(target) == c).alias(f"__n_{c}") for c in TARGET_CLASSES]


# --------------------------------------------------------------------------- KPIs
def kpis(tx: DataFrame) -> DataFrame:
    """Filtered-view KPIs: rows, fraud %, suspect %, total amount, date span.
    Rates divide by all rows (null target counts); empty input gives 0.0."""
    return tx.agg(
        F.count(F.lit(1)).alias("n_transactions"),
        r6(F.coalesce(F.avg(is_fraud(F.col("target"))) * 100, F.lit(0.0))).alias("taux_fraude"),
        r6(F.coalesce(F.avg(F.col("target").eqNullSafe(SUSPECT).cast("int")) * 100, F.lit(0.0))).alias("taux_suspect"),
        r6(F.coalesce(F.sum("amount"), F.lit(0.0))).alias("montant_total"),
        F.min("tx_ts").alias("date_min"),
        F.max("tx_ts").alias("date_max"),
    )


def dashboard_kpis(tx: DataFrame, exact_distinct: bool = True) -> DataFrame:
    """Dashboard KPIs; ``exact_distinct=False`` swaps in HyperLogLog++ for the
    distinct-client count (one fixed-size sketch per task, no distinct shuffle)."""
    distinct = (F.countDistinct("client_id") if exact_distinct
                else F.approx_count_distinct("client_id", 0.01))
    return tx.agg(
        F.count(F.lit(1)).alias("n_transactions"),
        _count_if(F.col("target") == FRAUD).alias("n_fraudes"),
        r6(F.coalesce(F.avg(is_fraud(F.col("target"))) * 100, F.lit(0.0))).alias("taux_fraude"),
        r6(F.coalesce(F.sum("amount"), F.lit(0.0))).alias("montant_total"),
        r6(F.avg("amount")).alias("montant_moyen"),
        distinct.alias("clients_uniques"),
    )


# --------------------------------------------------------------------------- target distribution
def _stack_classes(agg: DataFrame, value_name: str) -> DataFrame:
    pairs = ", ".join(f"'{c}', `__n_{c}`" for c in TARGET_CLASSES)
    return agg.selectExpr(f"stack({len(TARGET_CLASSES)}, {pairs}) as (statut, {value_name})", "*")


def target_distribution(tx: DataFrame) -> DataFrame:
    """Count and share of each of the 3 classes (absent class -> 0); the share
    divides by the rows of the 3 classes (floor 1)."""
    agg = tx.agg(*_class_counts())
    total = sum((F.col(f"__n_{c}") for c in TARGET_CLASSES), F.lit(0))
    stacked = _stack_classes(agg.withColumn("__tot", total), "nombre")
    return stacked.select(
        "statut", F.col("nombre").cast("long").alias("nombre"),
        r6(F.col("nombre").cast("double") / F.greatest(F.col("__tot"), F.lit(1)) * 100).alias("pourcentage"))


def target_share_pie(tx: DataFrame) -> DataFrame:
    """Counts per class; an absent class stays NULL (no zero fill)."""
    stacked = _stack_classes(tx.agg(*_class_counts()), "nombre")
    return stacked.select("statut", F.when(F.col("nombre") > 0, F.col("nombre")).cast("long").alias("nombre"))


# --------------------------------------------------------------------------- location analytics
def _location_volumes(tx: DataFrame) -> DataFrame:
    """One aggregate per location: volume (all rows) and per-class counts."""
    return (tx.where(F.col("location").isNotNull())
            .groupBy("location")
            .agg(F.count(F.lit(1)).alias("__vol"), F.count("target").alias("__ntarget"), *_class_counts()))


def _top_by_volume(vol: DataFrame, n: int, volume_col: str = "__vol") -> DataFrame:
    """Top-n rows of an aggregated table by volume desc then name; adds ``rang``."""
    top = vol.orderBy(F.desc(volume_col), F.asc("location")).limit(n)
    w = Window.orderBy(F.desc(volume_col), F.asc("location"))  # over <= n rows
    return top.withColumn("rang", F.row_number().over(w).cast("long"))


def top_locations(tx: DataFrame, n: int = 15) -> DataFrame:
    vol = tx.where(F.col("location").isNotNull()).groupBy("location").agg(F.count(F.lit(1)).alias("__vol"))
    return _top_by_volume(vol, n).select("location", "rang", F.col("__vol").alias("nombre"))


def location_status_rate(tx: DataFrame, nb_top: int = 10) -> DataFrame:
    """% of each status among the classed rows of the nb_top busiest locations."""
    top = _top_by_volume(_location_volumes(tx), nb_top)
    return top.select(
        "location", "rang",
        *[r6(safe_ratio(F.col(f"__n_{c}"), F.col("__ntarget")) * 100).alias(f"pct_{c.lower()}")
          for c in TARGET_CLASSES])


def location_type_volume(tx: DataFrame, nb_top: int = 10) -> DataFrame:
    """Volume per (location, type) for the nb_top busiest locations (one scan)."""
    # one row per (location, type): written, read by the top-N and the result
    pair = written_once(tx.where(F.col("location").isNotNull())
                        .groupBy("location", "tx_type").agg(F.count(F.lit(1)).alias("nombre")), "location_types")
    vol = pair.groupBy("location").agg(F.sum("nombre").alias("__vol"))
    top = _top_by_volume(vol, nb_top).select("location")
    # top holds at most nb_top rows: broadcast size is bounded by the parameter.
    return (pair.where(F.col("tx_type").isNotNull())
            .join(F.broadcast(top), "location", "left_semi")
            .select("location", "tx_type", "nombre"))


def location_type_rollup(tx: DataFrame, nb_top: int = 10) -> DataFrame:
    """Hierarchical totals (treemap): (location, type), (location), grand total."""
    vol = location_type_volume(tx, nb_top)
    return (vol.rollup("location", "tx_type")
            .agg(F.sum("nombre").cast("long").alias("nombre"), F.grouping_id().cast("long").alias("niveau")))


# --------------------------------------------------------------------------- status cross-tabs
def status_by_type(tx: DataFrame) -> DataFrame:
    return (tx.where(F.col("tx_type").isNotNull() & F.col("target").isNotNull())
            .groupBy("tx_type", "target").agg(F.count(F.lit(1)).alias("nombre")))


def target_share_by(tx: DataFrame, by: str) -> DataFrame:
    """100%-stacked share of each target within each value of ``by``."""
    counts = (tx.where(F.col(by).isNotNull() & F.col("target").isNotNull())
              .groupBy(by, "target").agg(F.count(F.lit(1)).alias("nombre")))
    w = Window.partitionBy(by)  # over the aggregated table (values x classes rows)
    return counts.withColumn("pourcentage", r6(F.col("nombre") * 100.0 / F.sum("nombre").over(w)))


def _rate_columns() -> list[Column]:
    return [r6(safe_ratio(F.col(f"__n_{c}"), F.col("__ntarget")) * 100).alias(f"pct_{c.lower()}")
            for c in TARGET_CLASSES]


def status_rate_by_hour(tx: DataFrame) -> DataFrame:
    """% of each status per hour of day (only hours that have classed rows)."""
    g = (tx.withColumn("heure", hour_of(F.col("tx_ts")))
         .where(F.col("heure").isNotNull() & F.col("target").isNotNull())
         .groupBy("heure").agg(F.count("target").alias("__ntarget"), *_class_counts()))
    return g.select("heure", *_rate_columns())


def status_rate_by_weekday(tx: DataFrame) -> DataFrame:
    """% of each status per weekday; all 7 days in order, absent day -> NULL."""
    g = (tx.withColumn("jour_num", weekday_of(F.col("tx_ts")))
         .where(F.col("jour_num").isNotNull() & F.col("target").isNotNull())
         .groupBy("jour_num").agg(F.count("target").alias("__ntarget"), *_class_counts()))
    days = tx.sparkSession.range(7).select(F.col("id").cast("int").alias("jour_num"))
    return (days.join(g, "jour_num", "left")
            .select(weekday_label(F.col("jour_num")).alias("jour"), "jour_num", *_rate_columns()))


def target_crosstabs(tx: DataFrame) -> DataFrame:
    """Counts per target along five dimensions (type, operation status, hour,
    weekday, day) from ONE scan with GROUPING SETS, long form
    (dimension, valeur, target, nombre); rows with a null dimension value or a
    null target are left out, as in each single cross-tab."""
    ts = F.col("tx_ts")
    dims = {"tx_type": F.col("tx_type"), "op_status": F.col("op_status"),
            "heure": hour_of(ts).cast("string"), "jour_semaine": weekday_of(ts).cast("string"),
            "jour": F.to_date(ts).cast("string")}
    base = tx.where(F.col("target").isNotNull()).select("target", *[v.alias(k) for k, v in dims.items()])
    g = base.groupingSets([[k, "target"] for k in dims], *dims.keys(), "target").agg(
        F.count(F.lit(1)).alias("nombre"), *[F.grouping(k).alias(f"__g_{k}") for k in dims])
    name = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for k in dims:
        name = F.when(F.col(f"__g_{k}") == 0, F.lit(k)).otherwise(name)
        value = F.when(F.col(f"__g_{k}") == 0, F.col(k)).otherwise(value)
    return g.select(name.alias("dimension"), value.alias("valeur"), "target", "nombre").where(
        F.col("valeur").isNotNull())


def daily_trend(tx: DataFrame) -> DataFrame:
    return (tx.withColumn("jour", F.to_date("tx_ts"))
            .where(F.col("jour").isNotNull() & F.col("target").isNotNull())
            .groupBy("jour", "target").agg(F.count(F.lit(1)).alias("nombre")))


# --------------------------------------------------------------------------- correlations
def client_counts(tx: DataFrame, count_col: str = "operation_id", name: str = "nb_transactions_client") -> DataFrame:
    """Per-client count of non-null ``count_col``; map-side combined, so a hot
    client costs one partial row per task, never a gathered group."""
    return (tx.where(F.col("client_id").isNotNull())
            .groupBy("client_id").agg(F.count(count_col).alias(name)))


def with_client_count(tx: DataFrame, count_col: str = "operation_id",
                      name: str = "nb_transactions_client") -> DataFrame:
    """Group count broadcast back to rows (left join: a null client never
    matches, so its count stays NULL). AQE splits a skewed client partition."""
    return tx.join(client_counts(tx, count_col, name), "client_id", "left")


CORR_FEATURES = ["montant", "montant_log", "heure", "jour_semaine", "est_weekend",
                 "nb_transactions_client", "est_fraude", "est_suspect_ou_fraude"]
# The column that is null in the same rows; None: never null.
CORR_MASK = {"montant": "montant", "montant_log": "montant", "heure": "heure", "jour_semaine": "heure",
             "nb_transactions_client": "nb_transactions_client", "est_weekend": None, "est_fraude": None,
             "est_suspect_ou_fraude": None}


def correlation_matrix(tx: DataFrame) -> DataFrame:
    """Pairwise-complete Pearson correlation of 8 numeric features, long form
    (var_x, var_y, r). Constant columns give NULL (no ANSI error)."""
    num = with_client_count(tx, "client_id").select(
        F.col("amount").alias("montant"),
        clipped_log_amount(F.col("amount")).alias("montant_log"),
        hour_of(F.col("tx_ts")).cast("double").alias("heure"),
        weekday_of(F.col("tx_ts")).cast("double").alias("jour_semaine"),
        weekend_flag(weekday_of(F.col("tx_ts"))).cast("double").alias("est_weekend"),
        F.col("nb_transactions_client").cast("double").alias("nb_transactions_client"),
        is_fraud(F.col("target")).cast("double").alias("est_fraude"),
        is_suspect_or_fraud(F.col("target")).cast("double").alias("est_suspect_ou_fraude"),
    )
    # One global aggregate; a pair uses the rows where both values are present. Columns of one mask are null in the
    # same rows, so a column needs one deviation for each other mask, not one for each other column. The matrix is
    # unfolded from the single aggregated row.
    names = CORR_FEATURES
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]

    def spread(c: str, other: str) -> str:
        """Name of the deviation of c over the rows where ``other`` is present too."""
        mask = CORR_MASK[other]
        return f"{c}~" if mask in (None, CORR_MASK[c]) else f"{c}~{mask}"

    spreads = {spread(c, o): F.stddev_pop(c if spread(c, o) == f"{c}~" else F.when(F.col(CORR_MASK[o]).isNotNull(), F.col(c)))
               for p in pairs for c, o in (p, p[::-1])}
    one = num.agg(*[v.alias(k) for k, v in spreads.items()], *[F.covar_pop(a, b).alias(f"{a}*{b}") for a, b in pairs])
    one = one.select(*[F.try_divide(F.col(f"{a}*{b}"), F.col(spread(a, b)) * F.col(spread(b, a))).alias(f"{a}|{b}")
                       for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(x).alias("var_x"), F.lit(y).alias("var_y"), r6(F.col(f"{a}|{b}")).alias("r"))
                      for a, b in pairs for x, y in dict.fromkeys([(a, b), (b, a)])])
    return one.select(F.inline(cells))


# --------------------------------------------------------------------------- data quality
def data_quality_profile(tx: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """rows, columns, null cells (NaN counts as missing), duplicate rows (nulls
    compare equal). Only a 128-bit digest of each row is shuffled."""
    cols = columns or TX_COLUMNS
    dtypes = dict(tx.dtypes)

    def missing(c: str) -> Column:
        m = F.col(c).isNull()
        if dtypes[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        return m.cast("long")

    per_row_missing = sum((missing(c) for c in cols), F.lit(0).cast("long"))
    whole = tx.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(per_row_missing), F.lit(0)).alias("m"))
    different = tx.select(*_digest(cols)).distinct().agg(F.count(F.lit(1)).alias("d"))
    # one row each
    return whole.join(F.broadcast(different)).select(
        F.col("n").cast("long").alias("n_lignes"), F.lit(len(cols)).cast("long").alias("n_colonnes"),
        F.col("m").cast("long").alias("valeurs_manquantes"), (F.col("n") - F.col("d")).cast("long").alias("doublons"))


def _digest(cols: list[str]) -> list[Column]:
    """128 bits of a row's values and of where its nulls are: equal rows share them."""
    values = [x for c in cols for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(1), *values).alias("__d1"), F.xxhash64(F.lit(2), *values).alias("__d2")]


def column_types(tx: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column: its type, as a name that SQL engines share, and its values that are not missing."""
    cols = columns or TX_COLUMNS
    names = {"bigint": "entier", "int": "entier", "double": "decimal", "string": "texte", "timestamp": "horodatage"}
    dtypes = dict(tx.dtypes)
    nulls = null_counts_by_column(tx, cols)
    types = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(names.get(dtypes[c], dtypes[c])))])
    return nulls.select("colonne", F.element_at(types, F.col("colonne")).alias("type"), "nulls")


def null_counts_by_column(tx: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or TX_COLUMNS
    dtypes = dict(tx.dtypes)
    aggs = []
    for c in cols:
        m = F.col(c).isNull()
        if dtypes[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        aggs.append(F.count_if(m).alias(c))
    wide = tx.agg(*aggs)
    return wide.unpivot([], cols, "colonne", "nulls").select("colonne", F.col("nulls").cast("long"))


def duplicate_rows(tx: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distinct rows that occur more than once, with their multiplicity. Digests
    are counted first; only rows of repeated digests are grouped in full."""
    cols = columns or TX_COLUMNS
    rows = tx.select(*cols, *_digest(cols))
    repeated = rows.groupBy("__d1", "__d2").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1).drop("__n")
    return (rows.join(repeated, ["__d1", "__d2"], "left_semi").groupBy(*cols)
            .agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1))


# --------------------------------------------------------------------------- distributions
DESCRIBE_PROBS = [0.25, 0.5, 0.75]


def describe(tx: DataFrame, col: str = "amount", exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """pandas-style describe(): count, mean, std (n-1), min, 25%, 50%, 75%, max,
    long form (statistique, valeur). Quartiles are exact (linear interpolation)
    and computed without gathering the column into one task; ``exact=False``
    takes them from ``percentile_approx`` in the same single aggregation pass
    (rank error <= n / accuracy, no interpolation)."""
    base = tx.where(F.col(col).isNotNull() & ~F.isnan(F.col(col)))
    if not exact:
        qs = F.percentile_approx(F.col(col).cast("double"), DESCRIBE_PROBS, accuracy)
        row = base.agg(F.count(F.lit(1)).cast("double").alias("count"), F.avg(col).alias("mean"),
                       F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"),
                       qs.alias("__q"), F.max(col).cast("double").alias("max"))
        row = row.select("count", "mean", "std", "min", *[F.col("__q")[i].alias(f"{int(p * 100)}%")
                                                            for i, p in enumerate(DESCRIBE_PROBS)], "max")
        names = ["count", "mean", "std", "min"] + [f"{int(p * 100)}%" for p in DESCRIBE_PROBS] + ["max"]
        return row.unpivot([], names, "statistique", "valeur").select("statistique", r6(F.col("valeur")).alias("valeur"))
    m = base.agg(F.count(F.lit(1)).cast("double").alias("count"), F.avg(col).alias("mean"),
                 F.stddev_samp(col).alias("std"), F.min(col).cast("double").alias("min"),
                 F.max(col).cast("double").alias("max"))
    moments = m.unpivot([], ["count", "mean", "std", "min", "max"], "statistique", "valeur")
    # a row for each quartile, also of an empty column
    _, values = order_statistics(base, col, DESCRIBE_PROBS).get("", (0, [None] * len(DESCRIBE_PROBS)))
    q = tx.sparkSession.createDataFrame([(f"{int(p * 100)}%", v) for p, v in zip(DESCRIBE_PROBS, values)],
                                        "statistique string, valeur double")
    return moments.unionByName(q).select("statistique", r6(F.col("valeur")).alias("valeur"))


def categorical_columns(tx: DataFrame) -> list[str]:
    return [c for c, t in tx.dtypes if t == "string" and c not in HIGH_CARDINALITY]


def value_frequency(tx: DataFrame, top: int | None = UNIVARIATE_TOP, columns: list[str] | None = None) -> DataFrame:
    """Frequency of each value of each categorical column (nulls dropped), long
    form (colonne, valeur, nombre). With ``top``: the first values per column by
    count desc then value, with their rank - each column's top-k is a
    distributed partial top-k, so no column is gathered into one task. Without
    ``top``: every value, sorted by column, count desc, value (range-partitioned
    global sort)."""
    cols = columns or categorical_columns(tx)
    long = tx.select(*cols).unpivot([], cols, "colonne", "valeur").where(F.col("valeur").isNotNull())
    freq = long.groupBy("colonne", "valeur").agg(F.count(F.lit(1)).alias("nombre"))
    if not top:
        return freq.orderBy("colonne", F.desc("nombre"), F.asc("valeur"))
    # one row per distinct (column, value): written so every per-column top-k
    # reads it instead of rescanning the input
    freq = written_once(freq, "frequencies")
    parts = []
    for c in cols:
        k = freq.where(F.col("colonne") == c).orderBy(F.desc("nombre"), F.asc("valeur")).limit(top)
        w = Window.orderBy(F.desc("nombre"), F.asc("valeur"))  # over <= top rows
        parts.append(k.withColumn("rang", F.row_number().over(w).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def amount_histogram(tx: DataFrame, bins: int = 20, col: str = "amount") -> DataFrame:
    """Equal-width histogram of ``col`` from its min to max, split by target."""
    base = tx.where(F.col(col).isNotNull() & F.col("target").isNotNull())
    bounds = base.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).collect()[0]  # one row
    if bounds["lo"] is None:
        return base.select(F.lit(0).alias("bin"), F.lit(0.0).alias("bin_min"), F.lit(0.0).alias("bin_max"),
                           "target", F.lit(0).cast("long").alias("nombre")).limit(0)
    lo, hi = F.lit(float(bounds["lo"])), F.lit(float(bounds["hi"]))
    width = (hi - lo) / bins
    b = F.least(F.floor(F.try_divide(F.col(col) - lo, width)), F.lit(bins - 1))
    b = F.coalesce(b, F.lit(0)).cast("int")
    g = base.withColumn("bin", b).groupBy("bin", "target").agg(F.count(F.lit(1)).alias("nombre"))
    return g.select("bin", r6(lo + F.col("bin") * width).alias("bin_min"),
                    r6(lo + (F.col("bin") + 1) * width).alias("bin_max"), "target", "nombre")


def amount_box_by_target(tx: DataFrame, col: str = "amount") -> DataFrame:
    """Box-plot statistics per target: quartiles (linear interpolation) and
    whiskers at the most extreme values within 1.5 IQR of the box."""
    base = tx.where(F.col(col).isNotNull() & F.col("target").isNotNull())
    # a row for each target
    rows = [(t, *v) for t, (_, v) in sorted(order_statistics(base, col, DESCRIBE_PROBS, "target").items())]
    wide = tx.sparkSession.createDataFrame(rows, "target string, q1 double, mediane double, q3 double")
    fences = wide.withColumns({"__lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
                               "__hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    v = F.col(col)
    wh = (base.join(F.broadcast(fences.select("target", "__lo", "__hi")), "target")
          .groupBy("target").agg(F.min(F.when(v >= F.col("__lo"), v)).alias("moustache_basse"),
                                 F.max(F.when(v <= F.col("__hi"), v)).alias("moustache_haute")))
    return fences.join(wh, "target").select(
        "target", r6(F.col("q1")).alias("q1"), r6(F.col("mediane")).alias("mediane"), r6(F.col("q3")).alias("q3"),
        r6(F.col("moustache_basse")).alias("moustache_basse"), r6(F.col("moustache_haute")).alias("moustache_haute"))


# --------------------------------------------------------------------------- filters
@dataclass
class FilterSpec:
    """EDA filters; ``None`` means 'full domain'. Empty lists select nothing."""
    date_from: date | None = None
    date_to: date | None = None
    amount_min: float | None = None
    amount_max: float | None = None
    tx_types: list[str] | None = None
    targets: list[str] | None = None
    extra: dict = field(default_factory=dict)


def filter_predicate(spec: FilterSpec) -> Column:
    """Combined predicate. The date filter is always applied (rows without a
    date drop out) and is written as a half-open range on the raw timestamp so
    it can reach the scan."""
    ts = F.col("tx_ts")
    pred = ts.isNotNull()
    if spec.date_from is not None:
        pred = pred & (ts >= F.lit(spec.date_from).cast("timestamp"))
    if spec.date_to is not None:
        pred = pred & (ts < F.date_add(F.lit(spec.date_to), 1).cast("timestamp"))
    a = F.col("amount")
    pred = pred & a.isNotNull()
    if spec.amount_min is not None:
        pred = pred & (a >= F.lit(float(spec.amount_min)))
    if spec.amount_max is not None:
        pred = pred & (a <= F.lit(float(spec.amount_max)))
    if spec.tx_types is not None:
        pred = pred & F.col("tx_type").isin(list(spec.tx_types)) if spec.tx_types else pred & F.lit(False)
    else:
        pred = pred & F.col("tx_type").isNotNull()
    if spec.targets is not None:
        pred = pred & F.col("target").isin(list(spec.targets)) if spec.targets else pred & F.lit(False)
    else:
        pred = pred & F.col("target").isNotNull()
    return pred


def filtered_transactions(tx: DataFrame, spec: FilterSpec) -> DataFrame:
    return tx.where(filter_predicate(spec))


def filter_domains(tx: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sorted distinct values of the low-cardinality filter columns (long form)."""
    cols = columns or ["tx_type", "op_status", "location", "target"]
    return (tx.select(*cols).unpivot([], cols, "colonne", "valeur")
            .where(F.col("valeur").isNotNull()).distinct())


def filter_bounds(tx: DataFrame) -> DataFrame:
    return tx.agg(F.to_date(F.min("tx_ts")).alias("date_min"), F.to_date(F.max("tx_ts")).alias("date_max"),
                  F.min("amount").alias("montant_min"), F.max("amount").alias("montant_max"))


def filter_summary(tx: DataFrame, spec: FilterSpec) -> DataFrame:
    """Number of active filters (a filter is active when it differs from the
    full domain) and shown / total rows, in one aggregation."""
    d = F.to_date(F.col("tx_ts"))
    agg = tx.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(filter_predicate(spec)).alias("n_affichees"),
        F.min(d).alias("__dmin"), F.max(d).alias("__dmax"),
        F.min("amount").alias("__amin"), F.max("amount").alias("__amax"),
        # columns of few values: a set in one pass, where two distinct counts would copy every row
        F.size(F.collect_set("tx_type")).alias("__ntypes"), F.size(F.collect_set("target")).alias("__ntargets"),
    )
    active = F.lit(0)
    if spec.date_from is not None or spec.date_to is not None:
        lo = F.lit(spec.date_from) if spec.date_from is not None else F.col("__dmin")
        hi = F.lit(spec.date_to) if spec.date_to is not None else F.col("__dmax")
        active = active + F.when(F.col("__dmin").isNotNull() & ((lo != F.col("__dmin")) | (hi != F.col("__dmax"))), 1).otherwise(0)
    if spec.amount_min is not None or spec.amount_max is not None:
        lo = F.lit(float(spec.amount_min)) if spec.amount_min is not None else F.col("__amin")
        hi = F.lit(float(spec.amount_max)) if spec.amount_max is not None else F.col("__amax")
        active = active + F.when((lo != F.col("__amin")) | (hi != F.col("__amax")), 1).otherwise(0)
    if spec.tx_types is not None:
        active = active + F.when(F.lit(len(set(spec.tx_types))) != F.col("__ntypes"), 1).otherwise(0)
    if spec.targets is not None:
        active = active + F.when(F.lit(len(set(spec.targets))) != F.col("__ntargets"), 1).otherwise(0)
    return agg.select(active.cast("int").alias("n_filtres_actifs"), "n_affichees", "n_total")


def preview(tx: DataFrame, n: int = 20, order_col: str = "op_num") -> DataFrame:
    """First n rows in a defined order (file order is not defined in Spark)."""
    return tx.orderBy(order_col).limit(n)
