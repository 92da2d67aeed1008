"""Deterministic stratified train/test split, class weights, contamination.

The test set has ceil(fraction * n) rows; each class gets its proportional share,
and the rows that flooring leaves go to the classes with the largest remainders
(ties by class name). Within a class, rows are ordered by ``md5(key || ':' || seed)``,
then key, then a hash of the whole row, and the first ones go to test: the split
does not depend on the number of rows or on their partitions.

The order is never computed by sorting a class. Counts per (class, leading hash
digits) find the bucket that the quota falls into, counts of the next digits find
the bucket inside it, and the few rows there give the cut point. One row per class
reaches the driver, and one scan compares each row with its class's cut point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions.columns import r6
from fraudlens.functions.joins import broadcast_if_small
from fraudlens.schema import FRAUD
from fraudlens.session import written_once

HASH_PREFIX_HEX = 4     # 65,536 buckets per class and level
ORDER = ["__h", "__k", "__r"]  # hash, key, hash of the whole row
COPIES_PER_ROW = 10_000  # copies of one row that one generated row unfolds to


class UnknownLabelError(ValueError):
    """Rows carry labels outside the given vocabulary."""


def split_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def class_quotas(counts: dict[str, int], test_fraction: float) -> dict[str, int]:
    """Test rows per class: ceil(fraction * n) in total, by largest remainder."""
    n = sum(counts.values())
    total = math.ceil(test_fraction * n)
    quotas = {c: k * total // n for c, k in counts.items()} if n else {}
    by_remainder = sorted(counts, key=lambda c: (-(counts[c] * total % n) if n else 0, c))
    for c in by_remainder[:total - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def _bucket(level: int) -> Column:
    digits = F.substring("__h", 1 + level * HASH_PREFIX_HEX, HASH_PREFIX_HEX)
    return F.conv(digits, 16, 10).cast("int")


def _crossing(counts: DataFrame, group: list[str], order: list[str], wanted: dict[tuple, tuple[tuple, int]]) -> dict[tuple, dict]:
    """``wanted`` is name -> (group, quota). Per name: the first entry of ``counts`` (*group, *order, n) of its group
    whose running count reaches the quota, as a dict with ``before``, the count up to it."""
    spark, names = counts.sparkSession, sorted(wanted)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*group).orderBy(*order)
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fields = [f"{g} {counts.schema[g].dataType.simpleString()}" for g in group]
    # a row a class and quota
    quotas = spark.createDataFrame([(*wanted[x][0], i, wanted[x][1]) for i, x in enumerate(names)],
                                   ", ".join([*fields, "__name int", "__quota long"]))
    rows = counts.withColumn("before", before).join(F.broadcast(quotas), group).where(
        (F.col("before") < F.col("__quota")) & (F.col("before") + F.col("n") >= F.col("__quota"))).collect()
    return {names[r["__name"]]: r.asDict() for r in rows}  # at most one row a name


def _in_cells(label: str, cells: set[tuple]) -> Column:
    """Rows of the cells (class, bucket, ...)."""
    cond = F.lit(False)
    for c, *buckets in sorted(cells):
        here = F.col(label) == c
        for level, b in enumerate(buckets):
            here = here & (_bucket(level) == b)
        cond = cond | here
    return cond


def _ordered(df: DataFrame, key: str, seed: int) -> DataFrame:
    """``df`` with the columns of the split's order."""
    return (df.withColumn("__h", F.coalesce(split_hash(F.col(key), seed), F.lit("")))
            .withColumn("__k", F.coalesce(F.col(key).cast("string"), F.lit("")))
            .withColumn("__r", F.xxhash64(*[F.col(c) for c in df.columns])))


def _bucket_counts(work: DataFrame, label: str) -> DataFrame:
    """(label, __b0, n), written: at most classes x 65,536 rows."""
    return written_once(work.groupBy(label, _bucket(0).alias("__b0")).agg(F.count(F.lit(1)).alias("n")), "bucket_counts")


def _class_counts(c1: DataFrame, label: str) -> dict[str, int]:
    return {r[label]: r["n"] for r in c1.groupBy(label).agg(F.sum("n").alias("n")).collect()}  # one row per class


def _cut_points(work: DataFrame, c1: DataFrame, label: str, quotas: dict[tuple, int]) -> tuple[dict, dict]:
    """``quotas`` is (class, number) -> rows. For each: the entry of the order at which it is reached, and the rows of
    the quota that its last cell has to give. All of them from two scans besides the one of ``c1``."""
    at = _crossing(c1, [label], ["__b0"], {x: ((x[0],), q) for x, q in quotas.items()})
    cells = {x: (x[0], r["__b0"]) for x, r in at.items()}
    left = {x: quotas[x] - r["before"] for x, r in at.items()}
    buckets = ["__b0", "__b1"]
    c2 = work.where(_in_cells(label, set(cells.values()))).groupBy(
        label, *[_bucket(i).alias(b) for i, b in enumerate(buckets)]).agg(F.count(F.lit(1)).alias("n"))
    at = _crossing(c2, [label, "__b0"], ["__b1"], {x: (cells[x], left[x]) for x in at})
    cells = {x: (*cells[x], r["__b1"]) for x, r in at.items()}
    left = {x: left[x] - r["before"] for x, r in at.items()}
    # copies of a row are one entry; copies of a key with other values differ in the row's hash
    c3 = work.where(_in_cells(label, set(cells.values()))).groupBy(
        label, *[_bucket(i).alias(b) for i, b in enumerate(buckets)], *ORDER).agg(F.count(F.lit(1)).alias("n"))
    return _crossing(c3, [label, *buckets], ORDER, {x: (cells[x], left[x]) for x in at}), left


def stratified_folds(df: DataFrame, folds: int = 5, key: str = "operation_id", label: str = "target", seed: int = 42,
                     out_col: str = "fold") -> DataFrame:
    """Add ``fold`` 0..folds-1: every class is cut into equal parts of its hash
    order (equal rows stay together)."""
    work = _ordered(df.where(F.col(label).isNotNull()), key, seed + 1)
    c1 = _bucket_counts(work, label)
    counts = _class_counts(c1, label)
    quotas = {(c, i): n * i // folds for c, n in counts.items() for i in range(1, folds)}
    cuts = _cut_points(work, c1, label, {x: q for x, q in quotas.items() if q})[0] if any(quotas.values()) else {}
    fold = F.lit(0)
    for (c, i), q in quotas.items():
        after = F.lit(True)
        if q:
            after = F.struct(*ORDER) > F.struct(*[F.lit(cuts[c, i][o]).alias(o) for o in ORDER])
        fold = fold + ((F.col(label) == c) & after).cast("int")
    return work.withColumn(out_col, fold).select(*df.columns, out_col)


def stratified_split(df: DataFrame, key: str = "operation_id", label: str = "target", test_fraction: float = 0.2,
                     seed: int = 42, out_col: str = "is_test", classes: list[str] | None = None) -> DataFrame:
    """Add boolean ``is_test``; rows with a null label are left out (they cannot
    be learned from). With ``classes`` (the label vocabulary) a row with another
    label raises, as the label encoder of a model would."""
    work = _ordered(df.where(F.col(label).isNotNull()), key, seed)
    c1 = _bucket_counts(work, label)
    counts = _class_counts(c1, label)
    unknown = {c: n for c, n in counts.items() if classes is not None and c not in classes}
    if unknown:
        raise UnknownLabelError(f"labels outside the vocabulary: {unknown}")
    quotas = {(c, 0): q for c, q in class_quotas(counts, test_fraction).items() if q > 0}
    if not quotas:
        return df.where(F.col(label).isNotNull()).withColumn(out_col, F.lit(False))
    found, rest = _cut_points(work, c1, label, quotas)
    cuts, left = {c: r for (c, _), r in found.items()}, {c: n for (c, _), n in rest.items()}

    is_test, straddles = F.lit(False), F.lit(False)
    for c, r in cuts.items():
        here, point = F.col(label) == c, F.struct(*[F.lit(r[o]).alias(o) for o in ORDER])
        is_test = is_test | (here & (F.struct(*ORDER) <= point))
        if left[c] - r["before"] < r["n"]:
            straddles = straddles | (here & (F.struct(*ORDER) == point))
    out = work.withColumn(out_col, is_test)
    if not any(left[c] - r["before"] < r["n"] for c, r in cuts.items()):
        return out.select(*df.columns, out_col)
    # Equal rows across the cut cannot be told apart: one of them is unfolded to as many test and train copies.
    one = work.where(straddles).dropDuplicates([label, *ORDER])
    taken = {c: left[c] - r["before"] for c, r in cuts.items()}
    runs = F.create_map(*[x for c, r in cuts.items() for x in (F.lit(c), F.array(*[
        F.struct(F.lit(n).cast("long").alias("n"), F.lit(t).alias("t"))
        for n, t in ((taken[c], True), (r["n"] - taken[c], False))]))])[F.col(label)]
    one = one.select(*df.columns, F.explode(runs).alias("__run"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("__run.n"), F.lit(COPIES_PER_ROW).cast("long")))
    one = one.withColumn("__from", step).where(F.col("__from") < F.col("__run.n"))
    one = one.withColumn("__copy", F.explode(F.sequence(
        F.col("__from"), F.least(F.col("__from") + COPIES_PER_ROW, F.col("__run.n")) - 1)))
    copies = one.select(*df.columns, F.col("__run.t").alias(out_col))
    return out.where(~straddles).select(*df.columns, out_col).unionByName(copies)


def balanced_weights(train: DataFrame, label: str = "target") -> DataFrame:
    """'balanced' weights n / (k * n_c) over the training rows, unrounded."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("n_train"))
    w = Window.partitionBy()  # over k rows (one per class)
    return counts.select(label, "n_train", (F.sum("n_train").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_train")))
                         .alias("weight"))


def class_weights(train: DataFrame, label: str = "target") -> DataFrame:
    """The balanced weights for display, rounded."""
    return balanced_weights(train, label).withColumn("weight", r6(F.col("weight")))


def with_class_weights(train: DataFrame, label: str = "target", weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight to each training row (k-row lookup, broadcast
    after a size check)."""
    cw = balanced_weights(train, label).select(label, F.col("weight").alias(weight_col))
    return train.join(broadcast_if_small(cw), label)


def fraud_share(train: DataFrame, label: str = "target") -> DataFrame:
    """Share of fraud rows, unrounded: what the anomaly detector receives."""
    return train.agg(F.avg(F.col(label).eqNullSafe(FRAUD).cast("double")).alias("contamination"))


def contamination_rate(train: DataFrame, label: str = "target") -> DataFrame:
    """The fraud share for display, rounded."""
    return fraud_share(train, label).withColumn("contamination", r6(F.col("contamination")))
