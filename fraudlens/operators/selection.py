"""Exact order statistics and heavy hitters without shuffling the values.

* :func:`order_statistics` refines the cell that holds each wanted rank by histograms of 16 bits: doubles map to unsigned
  integers in the same order, and each of four scans counts the next 16 bits of the values that share the bits found
  so far. A scan shuffles at most 65,536 counts a wanted cell, whatever the number of rows or of distinct values.
* :func:`top_values` finds the most frequent values of columns of high cardinality: each task keeps bounded counters
  (Misra-Gries), whose union names candidates; one more scan counts these exactly. A value that is no candidate
  occurs no more often than the tasks' decrements add up to, which proves that none is missed if the last of the top
  values occurs more often. Otherwise counters are widened, and in the end (a column whose values hardly repeat) all
  values are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.functions.joins import broadcast_if_small
from fraudlens.session import written_once

DIGIT_BITS = 16
LEVELS = 4
#: Counters of a task and column, and how often they are widened by WIDER.
COUNTERS = 1024
WIDER = 16
TRIES = 3


# ---- order statistics -----------------------------------------------------------------------------------------

def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles (-0.0 equals 0.0)."""
    u = (x + 0.0).view(np.uint64)
    sign = np.uint64(1 << 63)
    return np.where(u & sign, ~u, u | sign)


def doubles(u: np.ndarray) -> np.ndarray:
    sign = np.uint64(1 << 63)
    return np.where(u & sign, u & ~sign, ~u).astype(np.uint64).view(np.float64)


def _digit_counts(rows: DataFrame, prefixes: dict[str, list[int]] | None, level: int) -> dict[tuple[str, int], np.ndarray]:
    """Counts of the next digit for every (group, prefix); prefixes of level 0 are none (0)."""
    shift, size = np.uint64(64 - DIGIT_BITS * (level + 1)), 1 << DIGIT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            u = ordered_bits(b.column(1).to_numpy(zero_copy_only=False))
            digit = (u >> shift).astype(np.int64) & (size - 1)
            above = u >> (shift + np.uint64(DIGIT_BITS)) if level else np.zeros(len(u), np.uint64)
            names, code = np.unique(b.column(0).to_pylist(), return_inverse=True)
            for g, name in enumerate(names.tolist()):
                for prefix in ([0] if prefixes is None else prefixes.get(name, [])):
                    at = (code == g) & (above == np.uint64(prefix))
                    if at.any():
                        c = np.bincount(digit[at], minlength=size)
                        held[name, prefix] = held[name, prefix] + c if (name, prefix) in held else c
        for (name, prefix), c in held.items():
            d = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(d), pa.string()), pa.array([str(prefix)] * len(d)), pa.array(d.astype(np.int32)),
                 pa.array(c[d].astype(np.int64))], ["g", "prefix", "digit", "n"])

    found = rows.mapInArrow(count, "g string, prefix string, digit int, n long") \
        .groupBy("g", "prefix", "digit").agg(F.sum("n").alias("n")).toArrow()
    out: dict[tuple[str, int], np.ndarray] = {}
    for g, prefix, digit, n in zip(*(found.column(c).to_pylist() for c in ("g", "prefix", "digit", "n"))):
        out.setdefault((g, int(prefix)), np.zeros(size, np.int64))[digit] = n
    return out


def order_statistics(df: DataFrame, value_col: str, probs: list[float], group_col: str | None = None) \
        -> dict[str, tuple[int, list[float]]]:
    """group -> (count, quantiles at ``probs``) with linear interpolation (the default rule of pandas and numpy), exactly.
    Null and NaN values and null groups are left out; without ``group_col`` the group is ''. Groups are few (classes):
    the driver holds 65,536 counts for each wanted rank of a group."""
    value = F.col(value_col).cast("double")
    group = F.col(group_col).cast("string") if group_col else F.lit("")
    rows = df.select(group.alias("g"), value.alias("x")).where(F.col("g").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x"))
    counts = _digit_counts(rows, None, 0)
    total = {g: int(c.sum()) for (g, _), c in counts.items()}
    ranks = {g: sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}) for g, n in total.items()}
    # (prefix, rank inside it) of every wanted rank
    at = {(g, r): (0, r) for g, rs in ranks.items() for r in rs}
    for level in range(LEVELS):
        if level:
            prefixes: dict[str, list[int]] = {}
            for (g, _), (prefix, _) in at.items():
                prefixes.setdefault(g, [])
                prefixes[g] = sorted({*prefixes[g], prefix})
            counts = _digit_counts(rows, prefixes, level)
        for key, (prefix, rank) in at.items():
            ends = np.cumsum(counts[key[0], prefix])
            digit = int(np.searchsorted(ends, rank, "right"))
            at[key] = (prefix << DIGIT_BITS | digit, rank - int(ends[digit - 1] if digit else 0))
    out = {}
    for g, n in total.items():
        v = dict(zip(ranks[g], doubles(np.array([at[g, r][0] for r in ranks[g]], np.uint64)).tolist()))
        low = [math.floor(p * (n - 1)) for p in probs]
        out[g] = n, [v[r] + (p * (n - 1) - r) * (v[math.ceil(p * (n - 1))] - v[r]) for p, r in zip(probs, low)]
    return out


# ---- heavy hitters --------------------------------------------------------------------------------------------

class Counters:
    """Misra-Gries: at most ``size`` values; each stands for its count less at most ``lost``."""

    def __init__(self, size: int):
        self.size, self.counts, self.lost = size, {}, 0

    def add(self, values: list[str], counts: list[int]) -> None:
        held = self.counts
        for v, n in zip(values, counts):
            held[v] = held.get(v, 0) + n
        if len(held) > self.size:
            cut = sorted(held.values(), reverse=True)[self.size]
            self.lost += cut
            self.counts = {v: n - cut for v, n in held.items() if n > cut}


def _candidates(long: DataFrame, size: int) -> DataFrame:
    """(colonne, valeur): what the tasks' counters hold; valeur is null for what they lost, summed up in ``n``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counters] = {}
        for b in batches:
            columns = b.column(0).to_pylist()
            for name in sorted(set(columns)):
                of = pa.compute.filter(b.column(1), pa.compute.equal(b.column(0), name))
                c = pa.compute.value_counts(of)
                by.setdefault(name, Counters(size)).add(c.field(0).to_pylist(), c.field(1).to_pylist())
        rows = [(name, v, n) for name, c in by.items() for v, n in [*c.counts.items(), (None, c.lost)]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()),
                                          pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], ["colonne", "valeur", "n"])

    return long.mapInArrow(count, "colonne string, valeur string, n long").groupBy("colonne", "valeur").agg(
        F.sum("n").alias("n"))


def top_values(df: DataFrame, columns: list[str], top: int = 30, counters: int = COUNTERS, tries: int = TRIES) -> DataFrame:
    """(colonne, valeur, nombre, rang): the ``top`` most frequent values (as text, nulls dropped) of each column, ties by
    value, exactly."""
    w = Window.partitionBy("colonne").orderBy(F.desc("nombre"), F.asc("valeur"))
    parts, left = [], list(columns)
    while left:
        text = df.select(*[F.col(c).cast("string").alias(c) for c in left])
        long = text.unpivot([], left, "colonne", "valeur").where(F.col("valeur").isNotNull())
        if tries == 0:
            counts = long.groupBy("colonne", "valeur").agg(F.count(F.lit(1)).alias("nombre"))
            proven = left
        else:
            found = written_once(_candidates(long, counters), "candidates")
            lost = {r.colonne: r.n for r in found.where("valeur IS NULL").collect()}  # a row a column
            named = broadcast_if_small(found.where("valeur IS NOT NULL").select("colonne", "valeur"))
            counts = written_once(long.join(named, ["colonne", "valeur"]).groupBy("colonne", "valeur").agg(
                F.count(F.lit(1)).alias("nombre")), "candidate_counts")
            # the last of the top values, or the least of all if there are fewer and none was lost
            last = {r.colonne: (r.n, r.least) for r in counts.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
                    .groupBy("colonne").agg(F.count(F.lit(1)).alias("n"), F.min("nombre").alias("least")).collect()}
            proven = [c for c in left if lost.get(c, 0) == 0 or (c in last and last[c][0] == top and last[c][1] > lost[c])]
            counters, tries = counters * WIDER, tries - 1
        ranked = counts.where(F.col("colonne").isin(proven)).withColumn("rang", F.row_number().over(w).cast("long"))
        parts.append(ranked.where(F.col("rang") <= top))
        left = [c for c in left if c not in proven]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
