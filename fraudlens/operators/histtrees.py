"""Trees grown from histograms: decision tree, random forest, multinomial boosting.

Features are cut once into at most MAX_BINS intervals, and every split is a bin. The rows are binned, written once and
scanned; what is shuffled are histograms per (tree, node, feature, bin), added up inside each task first.

* *Classification trees* (`grow`): weighted Gini impurity, with the least rows of a node to split and of a leaf,
  without any limit of depth. Class histograms are counts, so sums are exact and any partitioning gives the same
  tree. While a node has more than LOCAL_ROWS rows, it is split from its shuffled histogram and its rows get the name of
  the child; a smaller node's rows meet in one task that grows the rest of its subtree. A tree is a table of nodes;
  a node is named by its path from the root (0 left, 1 right). A forest grows all its trees together, from Poisson
  bootstrap counts by hash, with features drawn for each node by a hash of its path.
* *Boosting* (`fit_boosting`): one regression tree for every class and round, split by Friedman's improvement. With the
  softmax loss leaf values are a Newton step of the log-loss; one-vs-rest is MLlib's binary boosting of each class against
  the others, leaf values the mean residual. The trees of a round share one aggregation a level; its sums are
  fixed-point integers, exact in any order. Rows are never moved: the scores of past rounds are part of the
  scanned table, which is written again every REFRESH rounds.
* *Few rows* (up to TASK_ROWS): a boosting fit is one task (`_LocalBoosting`, the same trees), and the fits of a boosting or
  forest grid are tasks side by side, each of which gets all rows and scores those that its fit leaves out.

A tree limited in depth or in the rows of a node to split is a cut of the unlimited one (nodes keep their class counts),
and a forest or boosting model of fewer trees is its first trees: the grids are searched on a few fits.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.functions.joins import broadcast_if_small
from fraudlens.schema import LABEL_ORDER
from fraudlens.session import written_once

MAX_BINS = 256
#: A node with no more rows is grown further by one task.
LOCAL_ROWS = 1 << 18
#: The same for forests, whose trees keep the tasks busy side by side.
FOREST_ROWS = 1 << 19
#: Cells of a histogram that a task keeps as a dense array.
DENSE_CELLS = 1 << 22
#: Rows up to which one task fits a boosting model or trees of a forest's grid, and the fits of a grid run side by side.
TASK_ROWS = 1 << 20
REFRESH = 10
CLASSES = len(LABEL_ORDER)
PROBABILITIES = [f"p_{c.lower()}" for c in LABEL_ORDER]


# ---- bins -----------------------------------------------------------------------------------------------------

@dataclass
class Bins:
    """``cuts`` of each feature, rising; a value's bin is the number of cuts not above it (null and NaN: all)."""
    columns: list[str]
    cuts: list[list[float]]

    @property
    def count(self) -> int:
        return max(map(len, self.cuts), default=0) + 1

    @property
    def widths(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    def of(self, values: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(np.array(c), v, side="right") for c, v in zip(self.cuts, values)], axis=1) \
            .astype(np.int16)


def fit_bins(df: DataFrame, columns: list[str], max_bins: int = MAX_BINS) -> Bins:
    """Cuts halfway between neighbouring values of a quantile sketch: all values of a feature that has few."""
    shares = F.array(*[F.lit(i / (max_bins - 1)) for i in range(max_bins)])
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), shares, 20_000).alias(f"q{i}")
                   for i, c in enumerate(columns)]).first()  # max_bins numbers a feature
    cuts = []
    for i in range(len(columns)):
        values = sorted(set(row[f"q{i}"] or []))
        cuts.append([(a + b) / 2 for a, b in zip(values, values[1:])])
    return Bins(list(columns), cuts)


def _numbers(b: pa.RecordBatch, columns: list[str]) -> list[np.ndarray]:
    return [b.column(b.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]


def _bin_names(bins: Bins) -> list[str]:
    return [f"b{i}" for i in range(len(bins.columns))]


def binned(df: DataFrame, bins: Bins, keep: dict[str, str] | None = None) -> DataFrame:
    """``keep`` (name -> type) and the bins b0, b1, ... of the features."""
    keep = keep or {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = bins.of(_numbers(b, bins.columns)) if b.num_rows else np.zeros((0, len(bins.columns)), np.int16)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(x[:, i]) for i in range(x.shape[1]))],
                [*keep, *_bin_names(bins)])

    schema = ", ".join([f"`{c}` {t}" for c, t in keep.items()] + [f"{n} short" for n in _bin_names(bins)])
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in bins.columns]).mapInArrow(cut, schema)


def _bins_of(b: pa.RecordBatch | pa.Table, features: int) -> np.ndarray:
    """(rows, features), a feature's values side by side."""
    return np.stack([b.column(b.schema.get_field_index(f"b{i}")).to_numpy() for i in range(features)]).T


# ---- classification trees -------------------------------------------------------------------------------------

@dataclass(frozen=True)
class TreeParams:
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None  # features tried at a node, all by default
    seed: int = 42


def _mix(*parts: int) -> int:
    """A 64-bit hash of integers (the finaliser of SplitMix64 over each)."""
    h = 0x9E3779B97F4A7C15
    for p in parts:
        h = (h ^ (p & 0xFFFFFFFFFFFFFFFF)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        h = (h ^ h >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        h ^= h >> 31
    return h


def feature_order(features: int, params: TreeParams, tree: int, path: str) -> list[int]:
    """Features in the order in which a node tries them."""
    if params.max_features is None or params.max_features >= features:
        return list(range(features))
    start = _mix(params.seed, tree, len(path), int("1" + path, 2) % (2 ** 61 - 1))
    return sorted(range(features), key=lambda f: _mix(start, f))


def best_split(hist: np.ndarray, class_weights: np.ndarray, params: TreeParams, order: list[int]) -> tuple[int, int]:
    """(feature, bin) of the best split of a class histogram (features, bins, classes), or (-1, -1). Ties go to the
    feature tried first, then to the lowest bin. Features beyond ``max_features`` are tried only while no split is
    possible."""
    total = hist[0].sum(axis=0)
    size = params.max_features or len(order)
    for lo in range(0, len(order), size):
        tried = order[lo:lo + size]
        left = np.cumsum(hist[tried], axis=1)[:, :-1]
        if not left.shape[1]:
            return -1, -1
        right = total - left
        n_left, n_right = left.sum(axis=2), right.sum(axis=2)
        allowed = (n_left >= max(1, params.min_samples_leaf)) & (n_right >= max(1, params.min_samples_leaf))
        if not allowed.any():
            continue
        wl, wr = left * class_weights, right * class_weights
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (wl * wl).sum(axis=2) / wl.sum(axis=2) + (wr * wr).sum(axis=2) / wr.sum(axis=2)
        gain[~allowed] = -np.inf
        at = int(np.argmax(gain))
        return tried[at // gain.shape[1]], at % gain.shape[1]
    return -1, -1


def splittable(counts: np.ndarray, depth: int, params: TreeParams) -> bool:
    n = int(counts.sum())
    return (n >= max(2, params.min_samples_split, 2 * params.min_samples_leaf) and int((counts > 0).sum()) > 1
            and (params.max_depth is None or depth < params.max_depth))


def add_histogram(total: np.ndarray, slot: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> None:
    """Add the counts of rows with multiplicity m to ``total`` (slots, features, bins, classes)."""
    slots, features, bins, _ = total.shape
    every = np.bincount(slot * CLASSES + y, m, slots * CLASSES).astype(np.int64).reshape(slots, CLASSES)
    for f in range(features):
        v = x[:, f]
        if bins > 1 and v.max(initial=0) <= 1:  # of a flag, only the ones are counted
            on = np.flatnonzero(v)
            ones = np.bincount(slot[on] * CLASSES + y[on], m[on], slots * CLASSES).astype(np.int64).reshape(slots, CLASSES)
            total[:, f, 0] += every - ones
            total[:, f, 1] += ones
        else:
            total[:, f] += np.bincount((slot * bins + v) * CLASSES + y, m, slots * bins * CLASSES) \
                .astype(np.int64).reshape(slots, bins, CLASSES)


def _gains(left: list[np.ndarray], total: list[np.ndarray], class_weights: np.ndarray, least: int) -> np.ndarray:
    """What :func:`best_split` maximises, from class counts to the left of splits and of their nodes."""
    right = [t - x for t, x in zip(total, left)]
    shares = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for side in (left, right):
            w = [c * x for c, x in zip(side, class_weights)]
            shares.append(sum(x * x for x in w) / sum(w))
        gain = shares[0] + shares[1]
    gain[(sum(left) < least) | (sum(right) < least)] = -np.inf
    return gain


def _best_flags(on: np.ndarray, of: np.ndarray, m: np.ndarray, total: np.ndarray, class_weights: np.ndarray,
                least: int) -> np.ndarray:
    """Gain of the nodes' split by a flag, ``on`` being the rows that have it, ``of`` a row's node x CLASSES + class."""
    nodes = len(total)
    ones = np.bincount(of[on], m[on], nodes * CLASSES).reshape(nodes, CLASSES)
    return _gains([total[:, c] - ones[:, c] for c in range(CLASSES)], [total[:, c] for c in range(CLASSES)], class_weights, least)


def _in_order(key: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three arrays by rising ``key``: sorted as one integer a row where they fit into its bits, y and m being whole."""
    bits = int(m.max()).bit_length()
    if int(key.max()).bit_length() + 2 + bits > 62:
        order = np.argsort(key)
        return key[order], y[order], m[order]
    packed = key << (2 + bits) | y << bits | m.astype(np.int64)
    packed.sort()
    return packed >> (2 + bits), packed >> bits & 3, (packed & (1 << bits) - 1).astype(np.float64)


def _best_bins(v: np.ndarray, slot: np.ndarray, y: np.ndarray, m: np.ndarray, total: np.ndarray, bins: int,
               class_weights: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(gain, bin) of the best split of every node by one feature, the lowest bin of equal ones; ``slot`` is the node of a
    row, ``v`` its bin, ``total`` the nodes' class counts. Nodes without rows get none."""
    nodes, of = len(total), [total[:, c] for c in range(CLASSES)]
    if not len(v):
        return np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
    if nodes * bins * CLASSES <= 4 * len(v):
        hist = np.bincount((slot * bins + v) * CLASSES + y, m, nodes * bins * CLASSES).reshape(nodes, bins, CLASSES)
        left = np.cumsum(hist, axis=1)[:, :-1]
        gain = _gains([left[..., c] for c in range(CLASSES)], [t[:, None] for t in of], class_weights, least)
        at = np.argmax(gain, axis=1)
        return gain[np.arange(nodes), at], at
    key, y, m = _in_order(slot * bins + v, y, m)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
    key = key[ends]
    node = key // bins
    start = np.append(0, np.flatnonzero(node[1:] != node[:-1]) + 1)  # first key of every node with rows
    rows_of = np.diff(np.append(start, len(node)))
    left = []
    for c in range(CLASSES):
        below = np.cumsum(np.where(y == c, m, 0.0))[ends]
        left.append(below - np.repeat(np.append(0.0, below[start[1:] - 1]), rows_of))
    gain = _gains(left, [t[node] for t in of], class_weights, least)
    best, out = np.full(nodes, -np.inf), np.zeros(nodes, np.int64)
    best[node[start]] = np.maximum.reduceat(gain, start)
    at = np.flatnonzero(gain == best[node])
    found, first = np.unique(node[at], return_index=True)
    out[found] = key[at[first]] % bins
    return best, out


def _mixed(start: np.ndarray, part) -> np.ndarray:
    """A step of :func:`_mix` over arrays."""
    h = (start ^ np.asarray(part).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def feature_orders(features: int, params: TreeParams, tree: int, depth: int, codes: np.ndarray) -> np.ndarray:
    """:func:`feature_order` of nodes of one depth; ``codes`` are their paths as binary numbers after a 1, modulo 2^61 - 1."""
    first = h = np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64)
    for part in (np.uint64(params.seed & 0xFFFFFFFFFFFFFFFF), np.uint64(tree), np.uint64(depth), codes):
        h = _mixed(h, part)
    h = _mixed(first, h)
    return np.argsort(_mixed(h[:, None], np.arange(features)[None, :]), axis=1, kind="stable")


def _best_splits(x: np.ndarray, slot: np.ndarray, y: np.ndarray, m: np.ndarray, total: np.ndarray, bins: int,
                 class_weights: np.ndarray, params: TreeParams, orders: np.ndarray | None,
                 flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`best_split` of many nodes at once: (feature, bin) of each, -1 where none is possible. ``x`` is (rows,
    features), ``flags`` tells which have two bins at most; ``orders``, by node, the features in the order tried, None for
    all in their own order."""
    nodes, features, least = len(total), x.shape[1], max(1, params.min_samples_leaf)
    feature, cut, classed = np.full(nodes, -1), np.full(nodes, -1), slot * CLASSES + y
    if orders is None:
        best = np.full(nodes, -np.inf)
        for f in range(features):
            if flags[f]:
                gain, at = _best_flags(np.flatnonzero(x[:, f]), classed, m, total, class_weights, least), np.zeros(nodes, int)
            else:
                gain, at = _best_bins(x[:, f], slot, y, m, total, bins, class_weights, least)
            better = gain > best
            best[better], feature[better], cut[better] = gain[better], f, at[better]
        return feature, cut
    left, values, rows = np.arange(nodes), x.ravel(), np.arange(len(x)) * features  # nodes without a split, where rows begin
    for lo in range(0, features, params.max_features):
        best, of = np.full(len(left), -np.inf), total[left]
        for j in range(lo, min(features, lo + params.max_features)):
            tried = orders[left, j]
            v, wide = values.take(rows + tried.take(slot)), ~flags[tried]
            # the nodes that try a flag here, and those that try another feature
            gain, at = np.full(len(left), -np.inf), np.zeros(len(left), np.int64)
            if not wide.all():
                gain = _best_flags(np.flatnonzero(v), classed, m, of, class_weights, least)
            if wide.any():
                place = np.cumsum(wide) - 1
                own = np.flatnonzero(wide[slot])
                gain[wide], at[wide] = _best_bins(v[own], place[slot[own]], y[own], m[own], of[wide], bins, class_weights, least)
            better = gain > best
            best[better], feature[left[better]], cut[left[better]] = gain[better], tried[better], at[better]
        rest = np.flatnonzero(best == -np.inf)
        if not len(rest):
            break
        place = np.full(len(left), -1)
        place[rest] = np.arange(len(rest))
        own = np.flatnonzero(place[slot] >= 0)
        rows, slot, y, m, left = rows[own], place[slot[own]], y[own], m[own], left[rest]
        classed = slot * CLASSES + y
    return feature, cut


def grow_locally(x: np.ndarray, y: np.ndarray, m: np.ndarray, bins: int, class_weights: np.ndarray, params: TreeParams,
                 tree: int, path: str) -> pa.Table:
    """The nodes of the subtree of these rows (NODE_SCHEMA)."""
    return _named_nodes(tree, path, *grown_subtree(x, y, m, bins, class_weights, params, tree, path))


def grown_subtree(x: np.ndarray, y: np.ndarray, m: np.ndarray, bins: int, class_weights: np.ndarray, params: TreeParams,
                  tree: int, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, counts) of the nodes of the subtree of these rows, found a level at a time, root first: the children
    of the k-th inner node are the nodes 2k + 1 and 2k + 2. Leaves have feature -1."""
    x = np.ascontiguousarray(x)
    y, m = y.astype(np.int64), m.astype(np.float64)
    slot, depth, nodes, levels = np.zeros(len(y), np.int64), len(path), 1, []
    codes = np.array([int("1" + path, 2) % (2 ** 61 - 1)], np.uint64)
    features = x.shape[1]
    flags = np.array([x[:, f].max(initial=0) <= 1 for f in range(features)])
    whole = params.max_features is None or params.max_features >= features
    while nodes:
        total = np.bincount(slot * CLASSES + y, m, nodes * CLASSES).reshape(nodes, CLASSES)
        n = total.sum(axis=1)
        going = (n >= max(2, params.min_samples_split, 2 * params.min_samples_leaf)) & ((total > 0).sum(axis=1) > 1) \
            & (params.max_depth is None or depth < params.max_depth)
        feature, cut = np.full(nodes, -1, np.int16), np.full(nodes, -1, np.int16)
        levels.append((feature, cut, total.astype(np.int64)))
        at = np.flatnonzero(going)
        if not len(at):
            break
        if len(at) < nodes:
            place = np.full(nodes, -1)
            place[at] = np.arange(len(at))
            rows = np.flatnonzero(place[slot] >= 0)
            x, y, m, slot = x[rows], y[rows], m[rows], place[slot[rows]]
        feature[at], cut[at] = _best_splits(x, slot, y, m, total[at], bins, class_weights, params, None if whole else
                                            feature_orders(features, params, tree, depth, codes[at]), flags)
        inner = np.flatnonzero(feature >= 0)
        if len(inner) < len(at):
            place = np.full(len(at), -1)
            place[np.flatnonzero(feature[at] >= 0)] = np.arange(len(inner))
            rows = np.flatnonzero(place[slot] >= 0)
            x, y, m, slot = x[rows], y[rows], m[rows], place[slot[rows]]
        side = x.ravel().take(np.arange(len(slot)) * features + feature[inner].take(slot)) > cut[inner].take(slot)
        slot = 2 * slot + side
        codes = ((np.repeat(codes[inner], 2) << np.uint64(1)) + np.tile(np.arange(2, dtype=np.uint64), len(inner))) \
            % np.uint64(2 ** 61 - 1)
        nodes = 2 * len(inner)
        depth += 1
    return tuple(np.concatenate([v[i] for v in levels]) for i in range(3))


NODE_SCHEMA = "tree int, node string, feature int, bin int, counts array<long>"


def _levels(feature: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of each level of a tree's nodes, root first."""
    lo, hi = 0, 1
    while lo < hi <= len(feature):
        yield lo, hi
        lo, hi = hi, hi + 2 * int((feature[lo:hi] >= 0).sum())


def _named_nodes(tree: int, path: str, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray) -> pa.Table:
    """Nodes of a subtree, as :func:`grown_subtree` gives them, with their names."""
    names, level = [], [path]
    for lo, hi in _levels(feature):
        names += level
        level = [p + s for p, f in zip(level, feature[lo:hi].tolist()) if f >= 0 for s in "01"]
    lists = pa.ListArray.from_arrays(np.arange(0, counts.size + 1, CLASSES, dtype=np.int32),
                                     np.asarray(counts, np.int64).ravel())
    return pa.table({"tree": pa.array(np.full(len(names), tree, np.int32)), "node": pa.array(names, pa.string()),
                     "feature": pa.array(feature, pa.int32()), "bin": pa.array(cut, pa.int32()), "counts": lists})


# Arrays stored together in one compressed value: a task holds the values that it reads, and unfolds one at a time.
def _packed(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    """The arrays of (type, width) each, (width, n) or (n,) where the width is 1."""
    out, at = [], 0
    whole = pa.decompress(data, n * sum(np.dtype(k).itemsize * w for k, w in kinds), "zstd") if n else b""
    for kind, width in kinds:
        a = np.frombuffer(whole, kind, n * width, at) if n else np.zeros(0, kind)
        out.append(a.reshape(width, n) if width > 1 else a)
        at += a.nbytes
    return out


#: A grown model: a row for each subtree that one task grew (nodes in the order of :func:`grown_subtree`), and for each
#: node above these, whose children are rows of their own.
SUBTREES = "tree int, path string, n int, data binary"
NODE_KINDS = [(np.int16, 1), (np.int16, 1), (np.int64, CLASSES)]


def _subtree(tree: int, path: str, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray) -> tuple:
    return tree, path, len(feature), _packed(np.asarray(feature, np.int16), np.asarray(cut, np.int16),
                                             np.asarray(counts, np.int64).reshape(-1, CLASSES).T)


def _subtree_nodes(n: int, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    feature, cut, counts = _unpacked(data, n, NODE_KINDS)
    return feature, cut, counts.T


# Training rows are kept in blocks: a row of a table holds up to BLOCK_ROWS training rows, so that a pass over them does
# not turn every bin of every row into a field of its own. Stored blocks are packed. Copies of rows for trees and folds
# are never stored: the tasks of a pass unfold them from the rows.
BLOCK_ROWS = 10_000
BLOCK = "node int, x binary, y binary, m binary, at binary"
KINDS = {"x": np.int16, "y": np.int8, "m": np.int32, "at": np.int32}
PACKED = "node int, n int, data binary"


def _x_kind(bins: int) -> type:
    return np.uint8 if bins <= 256 else np.int16


@dataclass
class Source:
    """A table of blocks and how a task unfolds them: ``read`` yields the rows of trees as arrays x (features, rows), y, m
    and at, the number of their tree or node."""
    table: DataFrame
    read: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, np.ndarray]]]


def _packed_batch(blocks: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b[i] for b in blocks], k) for i, k in enumerate(
        (pa.int32(), pa.int32(), pa.binary()))], ["node", "n", "data"])


def _packed_rows(node: int, t: dict[str, np.ndarray], rows, kind: type) -> tuple:
    y = t["y"][rows]
    return node, len(y), _packed(t["x"][:, rows].astype(kind, copy=False), *(t[c][rows].astype(KINDS[c], copy=False)
                                                                            for c in ("y", "m", "at")))


def _of_packed(features: int, kind: type) -> Callable:
    kinds = [(kind, features), *((KINDS[c], 1) for c in ("y", "m", "at"))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), b.column("data")):
                yield dict(zip(("x", "y", "m", "at"), _unpacked(data.as_buffer(), n, kinds)))

    return read


def _in_blocks(rows: DataFrame, features: int, kind: type, extra: dict[str, type]) -> DataFrame:
    """``rows`` (y, b0, ..., and the ``extra`` columns) in packed blocks of x, y and these."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(lo, BLOCK_ROWS)
                yield _packed_batch([(-1, b.num_rows, _packed(_bins_of(b, features).T.astype(kind), *(
                    b.column(b.schema.get_field_index(c)).to_numpy().astype(k) for c, k in {"y": np.int8, **extra}.items())))])

    return rows.mapInArrow(pack, PACKED)


class _Top:
    """The upper nodes of growing trees, by number: a tree's root has the tree's. Nodes get a split (feature, bin, left,
    right) or, ``final``, none; the others are still open."""

    def __init__(self, roots: dict[int, int]):
        every = range(max(roots, default=-1) + 1)
        self.tree, self.path, self.size = list(every), [""] * len(every), [roots.get(t, 0) for t in every]
        self.feature, self.bin, self.left, self.right = ([-1] * len(every) for _ in range(4))
        self.counts: dict[int, list[int]] = {}

    def put(self, node: int, feature: int, cut: int, counts: list[int], left: list[int]) -> list[int]:
        """Decide a node; its children."""
        self.counts[node] = counts
        if feature < 0:
            return []
        new = [len(self.tree), len(self.tree) + 1]
        self.feature[node], self.bin[node], (self.left[node], self.right[node]) = feature, cut, new
        for side, n in (("0", sum(left)), ("1", sum(counts) - sum(left))):
            self.tree.append(self.tree[node])
            self.path.append(self.path[node] + side)
            self.size.append(n)
            for values in (self.feature, self.bin, self.left, self.right):
                values.append(-1)
        return new

    def arrays(self) -> dict[str, np.ndarray]:
        return {k: np.array(getattr(self, k), np.int64) for k in ("feature", "bin", "left", "right")}

    def table(self, spark: SparkSession) -> DataFrame:
        """The decided nodes."""
        return spark.createDataFrame([_subtree(self.tree[i], self.path[i], [self.feature[i]], [self.bin[i]], c)
                                      for i, c in sorted(self.counts.items())], SUBTREES)


#: Levels that rows pass from the node they are stored with before they are stored anew.
STORED_LEVELS = 8


def _add_counts(total: np.ndarray, begin: np.ndarray, slot: np.ndarray, t: dict[str, np.ndarray]) -> None:
    """Add class counts of the rows ``t`` to ``total`` (slots, cells, classes), feature f having the cells from begin[f]."""
    slots, x, y, m = len(total), t["x"], t["y"].astype(np.int64), t["m"]
    every = np.bincount(slot * CLASSES + y, m, slots * CLASSES).astype(np.int64).reshape(slots, CLASSES)
    for f, (lo, hi) in enumerate(zip(begin, begin[1:])):
        if hi - lo == 2:  # of a flag, only the ones are counted
            on = np.flatnonzero(x[f])
            ones = np.bincount(slot[on] * CLASSES + y[on], m[on], slots * CLASSES).astype(np.int64).reshape(slots, CLASSES)
            total[:, lo] += every - ones
            total[:, lo + 1] += ones
        else:
            total[:, lo:hi] += np.bincount((slot * (hi - lo) + x[f]) * CLASSES + y, m, slots * (hi - lo) * CLASSES) \
                .astype(np.int64).reshape(slots, hi - lo, CLASSES)


def _split_large(work: Source, widths: list[int], top: _Top, large: list[int], weights: np.ndarray,
                 params: dict[int, TreeParams]) -> list:
    """(node, feature, bin, counts, left) of the large nodes, a row each: the class counts to the left of the split.
    Passes over the rows, of as many nodes as a task can hold histograms of; class counts are shuffled, added up inside
    each task first."""
    begin = np.append(0, np.cumsum(widths))
    step = max(1, DENSE_CELLS // int(begin[-1] * CLASSES))
    return [r for lo in range(0, len(large), step) for r in _split_some(work, begin, top, large[lo:lo + step], weights, params)]


def _split_some(work: Source, begin: np.ndarray, top: _Top, large: list[int], weights: np.ndarray,
                params: dict[int, TreeParams]) -> list:
    features, bins = len(begin) - 1, int(np.diff(begin).max())
    arrays, trees, paths = top.arrays(), {i: top.tree[i] for i in large}, {i: top.path[i] for i in large}
    place = np.full(len(top.tree), -1)
    place[large] = np.arange(len(large))
    numbers, read = np.array(large), work.read

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(numbers), begin[-1], CLASSES), np.int64)
        for t in read(batches):
            slot = place[descend(arrays, t["x"].T, t["at"])]
            rows = np.flatnonzero(slot >= 0)
            if not len(rows):
                continue
            if len(rows) < len(slot):
                t, slot = {c: v[..., rows] for c, v in t.items()}, slot[rows]
            here = np.zeros(len(numbers), np.int64)
            here[slot] = 1
            own = np.flatnonzero(here)  # the nodes that the block has rows of
            here[own] = np.arange(len(own))
            part = np.zeros((len(own), begin[-1], CLASSES), np.int64)
            _add_counts(part, begin, here[slot], t)
            held[own] += part
        n, cell = np.nonzero(held.any(axis=2))
        f = np.searchsorted(begin, cell, side="right") - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(numbers[n], pa.int32()), pa.array(f, pa.int32()), pa.array(cell - begin[f], pa.int32()),
             *(pa.array(held[n, cell, c]) for c in range(CLASSES))],
            ["node", "feature", "bin", *(f"c{c}" for c in range(CLASSES))])

    def split(g: pa.Table) -> pa.Table:
        node = g.column("node")[0].as_py()
        key = g.column("feature").to_numpy().astype(np.int64) * bins + g.column("bin").to_numpy()
        hist = np.stack([np.bincount(key, g.column(f"c{c}").to_numpy(), features * bins) for c in range(CLASSES)], axis=1) \
            .astype(np.int64).reshape(features, bins, CLASSES)
        p, counts, path = params[trees[node]], hist[0].sum(axis=0), paths[node]
        f, b = best_split(hist, weights, p, feature_order(features, p, trees[node], path)) \
            if splittable(counts, len(path), p) else (-1, -1)
        left = hist[f, :b + 1].sum(axis=0) if f >= 0 else np.zeros(CLASSES, np.int64)
        return pa.table({"node": pa.array([node], pa.int32()), "feature": pa.array([f], pa.int32()),
                         "bin": pa.array([b], pa.int32()), "counts": pa.array([counts.tolist()], pa.list_(pa.int64())),
                         "left": pa.array([left.tolist()], pa.list_(pa.int64()))})

    sums = ", ".join(f"c{c} long" for c in range(CLASSES))
    return work.table.mapInArrow(count, f"node int, feature int, bin int, {sums}").groupBy("node").applyInArrow(
        split, "node int, feature int, bin int, counts array<long>, left array<long>").collect()  # a row a large node


def _routed(work: Source, kind: type, top: _Top, large: list[int]) -> DataFrame:
    """The rows at the nodes where they now stand, without those of final leaves: packed blocks of one node each, and of
    node -1 with the rows of all the ``large`` ones."""
    arrays = top.arrays()
    state = np.zeros(len(top.tree), np.int64)
    state[list(top.counts)] = -1
    state[large] = 1
    read = work.read

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in read(batches):
            at, out = descend(arrays, t["x"].T, t["at"]), []
            t = t | {"at": at}
            kept = np.flatnonzero(state[at] > 0)
            if len(kept):
                out.append(_packed_rows(-1, t, kept, kind))
            rest = np.flatnonzero(state[at] == 0)
            rest = rest[np.argsort(at[rest], kind="stable")]
            for rows in np.split(rest, np.flatnonzero(np.diff(at[rest])) + 1):
                if len(rows):
                    out.append(_packed_rows(int(at[rows[0]]), t, rows, kind))
            if out:
                yield _packed_batch(out)

    return work.table.mapInArrow(move, PACKED)


#: Most partitions of the nodes that are grown to their end.
MAX_TASKS = 2000


def _partitions(spark: SparkSession) -> int:
    """Partitions for groups of much work in few bytes, which would be coalesced by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def grow(rows: DataFrame | Source, features: int, bins: int, class_weights: list[float], params: dict[int, TreeParams],
         local_rows: int = LOCAL_ROWS, sizes: dict[int, int] | None = None, widths: list[int] | None = None) -> DataFrame:
    """The trees (SUBTREES) from ``rows`` (tree, y class code, m count, b0, b1, ...); ``params`` by tree. With the trees'
    ``sizes`` (sums of m), ``rows`` are a source of such rows. ``widths`` are the bins of each feature. Of the nodes, those
    with more than ``local_rows`` rows and their children pass the driver, a small row each."""
    weights, kind, local_rows = np.array(class_weights, np.float64), _x_kind(bins), min(local_rows, PART_ROWS)
    packed = _of_packed(features, kind)
    if sizes is None:
        sizes = {r.tree: r.n for r in rows.groupBy("tree").agg(F.sum("m").alias("n")).collect()}  # a row a tree
        rows = Source(_in_blocks(rows.select("y", "m", F.col("tree").alias("at"), *[f"b{i}" for i in range(features)]),
                                 features, kind, {"m": np.int32, "at": np.int32}), packed)
    spark = rows.table.sparkSession
    top, work = _Top(sizes), rows
    small, large = [], [i for i, n in enumerate(top.size) if n > local_rows]
    if large:
        work = Source(written_once(work.table.repartition(_partitions(spark)), "tree_blocks"), work.read)
    while large:
        for _ in range(STORED_LEVELS):
            found = _split_large(work, widths or [bins] * features, top, large, weights, params)
            new = [c for r in sorted(found, key=lambda r: r.node) for c in top.put(*r)]
            large = [i for i in new if top.size[i] > local_rows]
            if not large:
                break
        if large:
            moved = written_once(_routed(work, kind, top, large), "tree_rows")
            small.append(moved.where("node >= 0"))
            work = Source(moved.where("node < 0"), packed)
    rest = _routed(work, kind, top, [])
    for s in small:
        rest = rest.unionByName(s)
    trees, paths = top.tree, top.path

    def finish(g: pa.Table) -> pa.Table:
        at, t = g.column("node")[0].as_py(), list(packed(g.to_batches()))
        x, y, m = (np.concatenate([b[c] for b in t], axis=-1) for c in ("x", "y", "m"))
        del t
        done = _subtree(trees[at], paths[at], *grown_subtree(x.T, y, m, bins, weights, params[trees[at]], trees[at], paths[at]))
        return pa.table([pa.array([v], k) for v, k in zip(done, (pa.int32(), pa.string(), pa.int32(), pa.binary()))],
                        ["tree", "path", "n", "data"])

    # more partitions than nodes in most cases: tasks of one node each, dealt out as cores get free
    few = 2 * sum(i not in top.counts for i in range(len(top.tree)))
    nodes = rest.repartition(min(max(_partitions(spark), few), MAX_TASKS), "node").groupBy("node") \
        .applyInArrow(finish, SUBTREES)
    return written_once(nodes.unionByName(top.table(spark)), "nodes")


class Tree:
    """The nodes of a tree or subtree as arrays, root first, a level after the other: the children of the k-th inner node
    are the nodes 2k + 1 and 2k + 2. ``depth`` is the root's."""

    def __init__(self, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray, depth: int = 0):
        inner = np.flatnonzero(feature >= 0)
        if len(feature) != 2 * len(inner) + 1:
            raise ValueError(f"{len(feature)} nodes, {len(inner)} of them inner: not a whole tree")
        self.feature, self.bin, self.counts = feature, cut, np.asarray(counts, np.float64)
        self.depth = np.concatenate([np.full(hi - lo, depth + i) for i, (lo, hi) in enumerate(_levels(feature))])
        self.children = np.full((len(feature), 2), -1, np.int64)
        self.children[inner] = np.arange(1, len(feature)).reshape(-1, 2)

    @staticmethod
    def of(nodes: pa.Table) -> "Tree":
        """From named nodes (NODE_SCHEMA)."""
        order = pa.compute.sort_indices(pa.table({"depth": pa.compute.utf8_length(nodes.column("node")),
                                                  "node": nodes.column("node")}),
                                        [("depth", "ascending"), ("node", "ascending")])
        nodes = nodes.take(order).combine_chunks()
        counts = nodes.column("counts").combine_chunks().flatten().to_numpy()
        return Tree(nodes.column("feature").to_numpy(), nodes.column("bin").to_numpy(), counts.reshape(-1, CLASSES))

    def ends(self, cuts: list[tuple[int | None, int]]) -> np.ndarray:
        """(cuts, nodes): where the tree cut at (max_depth, min_samples_split) ends on the way to each node."""
        n, out = self.counts.sum(axis=1), np.tile(np.arange(len(self.feature)), (len(cuts), 1))
        inner = np.flatnonzero(self.feature >= 0)
        parent = np.append(0, np.repeat(inner, 2))
        for own, (depth, least) in zip(out, cuts):
            end = (n < least) | (False if depth is None else self.depth >= depth)
            for lo, hi in list(_levels(self.feature))[1:]:
                up = parent[lo:hi]
                own[lo:hi] = np.where(end[up] | (own[up] != up), own[up], own[lo:hi])
        return out

    def leaves(self, x: np.ndarray, cuts: list[tuple[int | None, int]]) -> np.ndarray:
        """(cuts, rows): the node where each row ends in the tree cut at (max_depth, min_samples_split)."""
        at, todo = np.zeros(len(x), np.int64), np.arange(len(x))
        n = self.counts.sum(axis=1)
        ends = [(self.feature < 0) | (n < least) | (False if depth is None else self.depth >= depth) for depth, least in cuts]
        out = np.full((len(cuts), len(x)), -1, np.int64)
        while len(todo):
            here = at[todo]
            for i, end in enumerate(ends):
                new = end[here] & (out[i, todo] < 0)
                out[i, todo[new]] = here[new]
            todo = todo[self.feature[here] >= 0]
            here = at[todo]
            at[todo] = self.children[here, (x[todo, self.feature[here]] > self.bin[here]).astype(np.int64)]
        return out


#: Nodes that the driver and each task hold to score; a model with more meets its rows part by part.
SCORING_NODES = 200_000
#: Most (weighted by multiplicity) training rows of a subtree that one task grows: a part of a model that scores by parts.
PART_ROWS = 1 << 19
#: Shares of many trees are added up in multiples of its inverse, in any order.
SHARE_SCALE = float(1 << 50)
#: Rows whose shares are added up together.
SUM_ROWS = 1 << 13


class _Parts:
    """A model's subtrees and the nodes above them, which the driver holds. In ``children`` and ``root`` (by tree), part p
    is -1 - p."""

    def __init__(self, model: TreeModel):
        # a row a subtree; only the single nodes come with their content
        found = model.table.select("tree", "path", "n", F.when(F.col("n") == 1, F.col("data")).alias("data")).collect()
        above, self.numbers = [], {}
        for r in sorted(found, key=lambda r: (r.tree, len(r.path), r.path)):
            node = _subtree_nodes(1, bytes(r.data)) if r.n == 1 else None
            if node and node[0][0] >= 0:
                above.append((r.tree, r.path, *node))
            else:
                self.numbers[r.tree, r.path] = len(self.numbers)
        place = {v[:2]: i for i, v in enumerate(above)}
        self.tree_of, self.depth_of = ([f(k) for k in self.numbers] for f in (lambda k: k[0], lambda k: len(k[1])))

        def at(tree: int, path: str) -> int:
            return place[tree, path] if (tree, path) in place else -1 - self.numbers[tree, path]

        self.trees = sorted({r.tree for r in found})
        self.root = np.full(max(self.trees, default=-1) + 1, -1)
        for t in self.trees:
            self.root[t] = at(t, "")
        self.feature = np.array([v[2][0] for v in above], np.int64)
        self.bin = np.array([v[3][0] for v in above], np.int64)
        self.depth = np.array([len(v[1]) for v in above], np.int64)
        self.counts = np.array([v[4][0] for v in above], np.float64).reshape(-1, CLASSES)
        self.children = np.array([[at(v[0], v[1] + s) for s in "01"] for v in above], np.int64).reshape(-1, 2)

    def part(self, tree: np.ndarray, x: np.ndarray, passes=None) -> np.ndarray:
        """The part that each row falls into; ``passes`` is told (rows, their top nodes) on the way."""
        at, todo = self.root[tree], np.arange(len(x))
        while True:
            todo = todo[at[todo] >= 0]
            if not len(todo):
                return -1 - at
            here = at[todo]
            if passes:
                passes(todo, here)
            at[todo] = self.children[here, (x[todo, self.feature[here]] > self.bin[here]).astype(np.int64)]

    def nodes(self, model: TreeModel) -> DataFrame:
        """The subtrees below the top with their ``part``."""
        numbers = self.numbers

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                part = [numbers.get(k, -1) for k in zip(b.column("tree").to_pylist(), b.column("path").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column("n"), b.column("data")],
                                                 ["part", "n", "data"]).filter(pa.array([p >= 0 for p in part], pa.bool_()))

        return model.table.select("tree", "path", "n", "data").mapInArrow(find, "part int, n int, data binary")

    def meet(self, model: TreeModel, rows: DataFrame, score, schema: str) -> DataFrame:
        """``score(part, its Tree, its rows)`` of every part that has rows (``rows``: part, ...)."""
        depth_of = self.depth_of

        def both(nodes: pa.Table, own: pa.Table) -> pa.Table:
            part = nodes.column("part")[0].as_py()
            tree = Tree(*_subtree_nodes(nodes.column("n")[0].as_py(), nodes.column("data")[0].as_py()), depth_of[part])
            return score(part, tree, own.combine_chunks())

        n = min(max(_partitions(rows.sparkSession), len(depth_of)), MAX_TASKS)
        wanted = self.nodes(model).repartition(n, "part").groupBy("part")
        met = wanted.cogroup(rows.repartition(n, "part").groupBy("part")).applyInArrow(
            lambda a, b: both(a, b) if b.num_rows else _empty(schema), schema)
        return met


def _empty(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    return pa.table({name: pa.array([], kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))})


@dataclass
class TreeModel:
    """A decision tree or forest: the table of its subtrees (SUBTREES), read when it scores."""
    table: DataFrame
    bins: Bins
    class_weights: list[float]
    params: dict = field(default_factory=dict)

    @property
    def nodes(self) -> DataFrame:
        """The nodes (NODE_SCHEMA), named by their paths from the root."""

        def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for tree, path, n, data in zip(*(b.column(c).to_pylist() for c in ("tree", "path", "n", "data"))):
                    yield from _named_nodes(tree, path, *_subtree_nodes(n, data)).to_batches(max_chunksize=BLOCK_ROWS)

        return self.table.select("tree", "path", "n", "data").mapInArrow(unfold, NODE_SCHEMA)

    def trees(self, rows: list | pa.Table) -> dict[int, Tree]:
        if isinstance(rows, list):
            rows = pa.table({"tree": pa.array([r.tree for r in rows], pa.int32())}) if not rows else pa.Table.from_pylist(
                [r.asDict() for r in rows])
        of = rows.column("tree").to_numpy()
        return {t: Tree.of(rows.filter(pa.array(of == t))) for t in np.unique(of).tolist()}

    def groups(self) -> Iterator[dict[int, Tree]]:
        """The trees, at most SCORING_NODES nodes (or one tree) at a time."""
        sizes = {r.tree: r.n for r in self.table.groupBy("tree").agg(F.sum("n").alias("n")).collect()}  # a row a tree
        group, held = [], 0
        for t in sorted(sizes):
            if group and held + sizes[t] > SCORING_NODES:
                yield self.trees(self.nodes.where(F.col("tree").isin(group)).toArrow())
                group, held = [], 0
            group.append(t)
            held += sizes[t]
        if group:
            yield self.trees(self.nodes.where(F.col("tree").isin(group)).toArrow())

    def importances(self) -> DataFrame:
        """(feature, importance): weighted impurity that a feature's splits remove, a share within each tree, the mean of
        the trees. From the nodes' table: an inner node meets its children by their names."""
        w = F.array(*[F.lit(x) for x in self.class_weights])
        mass = F.zip_with("counts", w, lambda n, x: n * x)
        total = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate("mass", F.lit(0.0), lambda a, x: a + x * x)
        nodes = self.nodes.withColumn("mass", mass).withColumn("impure", total - squares / total)
        inner = nodes.where("feature >= 0").select("tree", "node", "feature", "impure")
        below = nodes.where("node != ''").select("tree", F.expr("left(node, length(node) - 1)").alias("node"), "impure") \
            .groupBy("tree", "node").agg(F.sum("impure").alias("left_over"))
        gains = inner.join(below, ["tree", "node"]).groupBy("tree", "feature").agg(
            F.sum(F.col("impure") - F.col("left_over")).alias("gain"))
        whole = gains.groupBy("tree").agg(F.sum("gain").alias("whole"), F.lit(1).alias("one"))
        trees = self.table.where("path = ''").count()
        names = F.array(*[F.lit(c) for c in self.bins.columns])
        mean = gains.join(whole, "tree").groupBy("feature").agg(
            F.sum(F.coalesce(F.try_divide("gain", "whole"), F.lit(0.0)) / F.lit(float(max(1, trees)))).alias("importance"))
        every = self.nodes.sparkSession.range(len(self.bins.columns)).select(F.col("id").cast("int").alias("feature"))
        return every.join(mean, "feature", "left").select(
            F.get(names, F.col("feature")).alias("feature"), F.coalesce("importance", F.lit(0.0)).alias("importance"))

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with the mean of the trees' class shares in PROBABILITIES."""
        if not df.isStreaming and (self.table.agg(F.sum("n")).first()[0] or 0) > SCORING_NODES:
            return self._by_parts(df)
        out, total = df, 0
        for i, trees in enumerate(self.groups()):
            out = self._add(out, trees, first=i == 0)
            total += len(trees)
        return out.withColumns({c: F.col(c) / F.lit(float(max(1, total))) for c in PROBABILITIES})

    def _by_parts(self, df: DataFrame) -> DataFrame:
        """:meth:`probabilities` where no task and not the driver holds the model: a row goes to the part of each tree that
        it falls into."""
        parts, bins, weights = _Parts(self), self.bins, np.array(self.class_weights)
        features, kind, trees = len(bins.columns), _x_kind(bins.count), len(parts.trees)
        base = [c for c in df.columns if c not in PROBABILITIES]
        rows = written_once(df.select(*base).withColumn("__row", F.monotonically_increasing_id()), "scored_rows")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x, number = bins.of(_numbers(b, bins.columns)), b.column(b.schema.get_field_index("__row")).to_numpy()
                for t in parts.trees:
                    part, blocks = parts.part(np.full(len(x), t), x), []
                    order = np.argsort(part, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        blocks.append((int(part[own[0]]), _packed(x[own].T.astype(kind)), number[own].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in blocks], k) for i, k in enumerate(
                        (pa.int32(), pa.binary(), pa.binary()))], ["part", "x", "at"])

        def score(part: int, tree: Tree, own: pa.Table) -> pa.Table:
            w = tree.counts * weights
            w /= w.sum(axis=1, keepdims=True)
            if trees > 1:
                w = np.rint(w * SHARE_SCALE)
            at = [np.frombuffer(v, np.int64) for v in own.column("at").to_pylist()]
            x = np.concatenate([_unpacked(v, len(a), [(kind, features)])[0].reshape(features, -1)
                                for v, a in zip(own.column("x").to_pylist(), at)], axis=1).T
            at, leaf = np.concatenate(at), tree.leaves(np.ascontiguousarray(x), [(None, 0)])[0]
            order, out = np.argsort(at, kind="stable"), []
            for some in np.split(order, np.flatnonzero(np.diff(at[order] // SUM_ROWS)) + 1):
                out.append((int(at[some[0]] // SUM_ROWS), len(some), _packed((at[some] % SUM_ROWS).astype(np.int16), w[leaf[some]].T)))
            return pa.table({c: pa.array([v[i] for v in out], k) for i, (c, k) in enumerate(
                (("block", pa.int64()), ("n", pa.int32()), ("data", pa.binary())))})

        def add(g: pa.Table) -> pa.Table:
            total, seen = np.zeros((CLASSES, SUM_ROWS), np.int64 if trees > 1 else np.float64), np.zeros(SUM_ROWS, bool)
            for n, data in zip(g.column("n").to_pylist(), g.column("data")):
                at, w = _unpacked(data.as_buffer(), n, [(np.int16, 1), (np.float64, CLASSES)])
                total[:, at] += w.astype(total.dtype)  # a part has a row once
                seen[at] = True
            at = np.flatnonzero(seen)
            p = total[:, at] / (SHARE_SCALE * trees) if trees > 1 else total[:, at]
            return pa.table({"__row": g.column("block")[0].as_py() * SUM_ROWS + at, **dict(zip(PROBABILITIES, p))})

        sent = rows.select("__row", *[F.col(c).cast("double").alias(c) for c in bins.columns]) \
            .mapInArrow(send, "part int, x binary, at binary")
        met = parts.meet(self, sent, score, "block long, n int, data binary")
        shares = met.repartition(_partitions(rows.sparkSession), "block").groupBy("block").applyInArrow(
            add, "__row long, " + ", ".join(f"{c} double" for c in PROBABILITIES))
        return rows.join(shares, "__row").drop("__row")

    def _add(self, df: DataFrame, trees: dict[int, Tree], first: bool) -> DataFrame:
        bins, weights, base = self.bins, np.array(self.class_weights), [c for c in df.columns if c not in PROBABILITIES]
        shared = df.sparkSession.sparkContext.broadcast(trees)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*base).schema)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = bins.of(_numbers(b, bins.columns)) if b.num_rows else np.zeros((0, len(bins.columns)), np.int16)
                p = np.zeros((b.num_rows, CLASSES)) if first else np.stack(_numbers(b, PROBABILITIES), axis=1)
                for t in shared.value.values():
                    w = t.counts * weights
                    p += (w / w.sum(axis=1, keepdims=True))[t.leaves(x, [(None, 0)])[0]]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(c)) for c in base), *(pa.array(p[:, c]) for c in range(CLASSES))],
                    [*base, *PROBABILITIES])

        return df.mapInArrow(score, f"{fields}, " + ", ".join(f"{c} double" for c in PROBABILITIES))


# ---- fits -----------------------------------------------------------------------------------------------------

def class_weights(train: DataFrame, label: str = "label") -> list[float]:
    """Balanced weights by class code."""
    n = {int(r[label]): r["count"] for r in train.groupBy(label).count().collect()}  # a row a class
    return [sum(n.values()) / (len(n) * n[c]) if n.get(c) else 0.0 for c in range(CLASSES)]


def binned_training(train: DataFrame, columns: list[str], keep: dict[str, str] | None = None,
                    max_bins: int = MAX_BINS) -> tuple[DataFrame, Bins]:
    """(y, ``keep``, b0, ...) of the training rows, written once, and the bins."""
    bins = fit_bins(train, columns, max_bins)
    rows = binned(train.withColumn("y", F.col("label").cast("tinyint")), bins, {"y": "tinyint", **(keep or {})})
    return written_once(rows, "binned"), bins


#: Chances that a Poisson number of mean one is at most 0, 1, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(12)])


def drawn(start: np.ndarray, tree: int) -> np.ndarray:
    """How often a tree draws the rows whose hashes are ``start``: a Poisson number of mean one by xxhash64 of the tree's
    number, started from the row's hash."""
    p1, p2, p3, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = start.view(np.uint64) + p5 + np.uint64(4) ^ np.uint64(tree * int(p1) & (1 << 64) - 1)
    h = (h << np.uint64(23) | h >> np.uint64(41)) * p2 + p3
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    h ^= h >> np.uint64(32)
    return np.searchsorted(POISSON, (h & np.uint64((1 << 53) - 1)) / float(1 << 53))


def _hashed(rows: DataFrame, features: int, seed: int, key: str, fold) -> DataFrame:
    """``rows`` with the hash h that their draws start from."""
    row_hash = F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns])
    return rows.select(F.xxhash64(row_hash, F.col(key)).alias("h"), fold.cast("int").alias("fold"), "y",
                       *[f"b{i}" for i in range(features)])


def draws(rows: DataFrame, features: int, bins: int, trees: int, seed: int, key: str,
          fits: list[int] | None = None) -> tuple[Source, dict[int, int]]:
    """``rows`` as often as every tree draws them, by a hash of the key and the row, and the trees' sizes. With ``fits``
    (the fold that each leaves out), fit i's trees have the numbers i x trees and so on. The table holds each row once;
    the numbers are drawn inside the tasks that read it."""
    source = _hashed(rows, features, seed, key, F.col("fold") if fits else F.lit(-1))
    of_fit, kind = fits or [-2], _x_kind(bins)
    kinds = [(kind, features), (np.int8, 1), (np.int64, 1), (np.int32, 1)]

    def copies(start: np.ndarray, fold: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for t in range(trees):
            m = drawn(start, t)
            for i, out in enumerate(of_fit):
                yield i * trees + t, m, np.flatnonzero((m > 0) & (fold != out))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(of_fit) * trees, np.int64)
        for b in batches:
            for tree, m, at in copies(b.column("h").to_numpy(), b.column("fold").to_numpy()) if b.num_rows else ():
                n[tree] += m[at].sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)], ["tree", "n"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), b.column("data")):
                x, y, start, fold = _unpacked(data.as_buffer(), n, kinds)
                for tree, m, at in copies(start, fold):
                    if len(at):
                        yield {"x": x.reshape(features, -1).take(at, axis=1), "y": y[at], "m": m[at], "at": np.full(len(at), tree)}

    found = source.select("h", "fold").mapInArrow(count, "tree int, n long").groupBy("tree").agg(F.sum("n").alias("n"))
    blocks = _in_blocks(source, features, kind, {"h": np.int64, "fold": np.int32})
    return Source(blocks, read), {r.tree: r.n for r in found.collect() if r.n}  # a row a tree


def bootstrapped(rows: DataFrame, features: int, trees: int, seed: int, key: str,
                 fits: list[int] | None = None) -> tuple[DataFrame, dict[int, int]]:
    """What :func:`draws` reads as a table of blocks, a block a tree, and the trees' sizes."""
    source, sizes = draws(rows, features, MAX_BINS + 1, trees, seed, key, fits)

    read = source.read

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in read(batches):
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *(pa.array([np.ascontiguousarray(
                t[c], KINDS[c]).tobytes()], pa.binary()) for c in KINDS)], ["node", *KINDS])

    return source.table.mapInArrow(out, BLOCK), sizes


def left_out(rows: DataFrame, features: int, bins: int, fits: list[int]) -> tuple[Source, dict[int, int]]:
    """``rows`` for each of the ``fits``, whose tree has its number: without the rows of the fold that it leaves out."""
    kind = _x_kind(bins)
    kinds = [(kind, features), (np.int8, 1), (np.int32, 1)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        for b in batches:
            for n, data in zip(b.column("n").to_pylist(), b.column("data")):
                x, y, fold = _unpacked(data.as_buffer(), n, kinds)
                for tree, out in enumerate(fits):
                    at = np.flatnonzero(fold != out)
                    if len(at):
                        yield {"x": x.reshape(features, -1).take(at, axis=1), "y": y[at], "m": np.ones(len(at), np.int32),
                               "at": np.full(len(at), tree)}

    counts = {r.fold: r["count"] for r in rows.groupBy("fold").count().collect()}  # a row a fold
    sizes = {i: sum(counts.values()) - counts.get(out, 0) for i, out in enumerate(fits)}
    return Source(_in_blocks(rows, features, kind, {"fold": np.int32}), read), {i: n for i, n in sizes.items() if n}


def fit_tree(train: DataFrame, columns: list[str], params: TreeParams | None = None, local_rows: int = LOCAL_ROWS,
             max_bins: int = MAX_BINS) -> TreeModel:
    rows, bins = binned_training(train, columns, max_bins=max_bins)
    weights = class_weights(train)
    one = rows.withColumn("tree", F.lit(0)).withColumn("m", F.lit(1))
    return TreeModel(grow(one, len(columns), bins.count, weights, {0: params or TreeParams()}, local_rows,
                          widths=bins.widths), bins, weights)


def fit_forest(train: DataFrame, columns: list[str], trees: int = 100, params: TreeParams | None = None,
               key: str = "operation_id", local_rows: int = FOREST_ROWS, max_bins: int = MAX_BINS) -> TreeModel:
    """Bootstrapped trees that try the square root of the features at each node."""
    params = params or TreeParams(max_features=max(1, int(math.sqrt(len(columns)))))
    kind = train.schema[key].dataType.simpleString()
    rows, bins = binned_training(train, columns, {key: kind}, max_bins)
    weights = class_weights(train)
    source, sizes = draws(rows, len(columns), bins.count, trees, params.seed, key)
    return TreeModel(grow(source, len(columns), bins.count, weights, dict.fromkeys(range(trees), params), local_rows, sizes,
                          bins.widths), bins, weights)


# ---- boosting -------------------------------------------------------------------------------------------------

@dataclass
class Boosted:
    """``trees[round][class]``: arrays feature, bin, left, right, value of a small tree, root first."""
    bins: Bins
    start: list[float]
    trees: list[list[dict[str, list]]]
    params: dict = field(default_factory=dict)
    one_vs_rest: bool = False

    def probabilities(self, df: DataFrame) -> DataFrame:
        model, base = self, [c for c in df.columns if c not in PROBABILITIES]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*base).schema)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = model.bins.of(_numbers(b, model.bins.columns)) if b.num_rows \
                    else np.zeros((0, len(model.bins.columns)), np.int16)
                raw = raw_scores(np.tile(model.start, (len(x), 1)), x, model.trees)
                p = class_shares(raw) if model.one_vs_rest else softmax(raw)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(b.schema.get_field_index(c)) for c in base), *(pa.array(p[:, c]) for c in range(CLASSES))],
                    [*base, *PROBABILITIES])

        return df.select(*base).mapInArrow(score, f"{fields}, " + ", ".join(f"{c} double" for c in PROBABILITIES))


def softmax(raw: np.ndarray) -> np.ndarray:
    e = np.exp(raw - raw.max(axis=1, keepdims=True, initial=-np.inf)) if len(raw) else raw
    return e / e.sum(axis=1, keepdims=True)


def class_shares(raw: np.ndarray) -> np.ndarray:
    """Each class's probability against the rest, renormalised."""
    p = 1 / (1 + np.exp(-2 * raw))
    return p / p.sum(axis=1, keepdims=True)


def softmax_residuals(y: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return (y[:, None] == np.arange(CLASSES)) - softmax(raw)


def signs(y: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """What the first one-vs-rest trees are fitted to: 1 for the own class, -1 for the others."""
    return np.where(y[:, None] == np.arange(CLASSES), 1.0, -1.0)


def binary_residuals(y: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Of the loss 2 log(1 + exp(-2 sign score)) of every class against the rest."""
    s = signs(y, raw)
    return 4 * s / (1 + np.exp(2 * s * raw))


def descend(tree: dict[str, list], x: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """The node of a (partly grown) tree where each row stands, from the root or the nodes ``start``."""
    feature, cut = np.array(tree["feature"]), np.array(tree["bin"])
    children = np.array([tree["left"], tree["right"]]).T
    at, todo = np.zeros(len(x), np.int64) if start is None else start.astype(np.int64), np.arange(len(x))
    while True:
        todo = todo[feature[at[todo]] >= 0]
        if not len(todo):
            return at
        here = at[todo]
        at[todo] = children[here, (x[todo, feature[here]] > cut[here]).astype(np.int64)]


def descend_small(tree: dict[str, list], x: np.ndarray) -> np.ndarray:
    """:func:`descend` from the root of a tree of few nodes, whose children stand side by side after their parent: a node
    at a time over whole columns."""
    at = np.zeros(len(x), np.int16)
    for node, (f, b, left) in enumerate(zip(tree["feature"], tree["bin"], tree["left"])):
        if f >= 0:
            at += (at == node) * ((x[:, f] > b) + np.int16(left - node))
    return at


def raw_scores(raw: np.ndarray, x: np.ndarray, rounds: list[list[dict[str, list]]]) -> np.ndarray:
    raw = np.array(raw, np.float64)
    for trees in rounds:
        for c, t in enumerate(trees):
            raw[:, c] += np.array(t["value"])[descend_small(t, x)]
    return raw


def _leaf(value: float = 0.0) -> dict[str, list]:
    return {"feature": [-1], "bin": [-1], "left": [-1], "right": [-1], "value": [value]}


def leaf_value(g: float, h: float, rate: float) -> float:
    """Newton step of the multinomial log-loss, g and h being the sums of residuals r and of |r|(1 - |r|)."""
    return 0.0 if abs(h) < 1e-150 else rate * (CLASSES - 1) / CLASSES * g / h


def best_regression_splits(hist: np.ndarray, begin: np.ndarray, scale: float, min_split: int, min_leaf: int) \
        -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, sums to the left) of the largest Friedman improvement of every node, feature -1 where there is none,
    from integer histograms (nodes, cells, sums), the first sums being [n, w, g]. Feature f has the cells from begin[f]."""
    nodes, last = np.arange(len(hist)), begin[1:] - 1
    left = np.cumsum(hist, axis=1)
    total = left[:, last[0]]
    of = np.repeat(np.arange(len(last)), np.diff(begin))
    left -= np.concatenate([np.zeros_like(left[:, :1]), left[:, last[:-1]]], axis=1)[:, of]
    right = total[:, None] - left
    least = max(1, min_leaf)
    allowed = (left[..., 0] >= least) & (right[..., 0] >= least) & (total[:, :1] >= max(2, min_split))
    (lw, lg), (rw, rg) = ((a[..., 1] / scale, a[..., 2] / scale) for a in (left, right))
    with np.errstate(divide="ignore", invalid="ignore"):
        diff = lg / lw - rg / rw
        gain = diff * diff * lw * rw / (total[:, 1:2] / scale)
    gain = np.where(allowed & np.isfinite(gain), gain, -np.inf)
    best = gain.max(axis=1, keepdims=True)
    # improvements within rounding of each other are equal: the lowest feature and bin wins
    at = np.argmax(gain >= best * (1 - 1e-9), axis=1)
    found = np.isfinite(best[:, 0]) & (best[:, 0] > 1e-12)
    return np.where(found, of[at], -1), np.where(found, at - begin[of[at]], -1), left[nodes, at]


def _sums(key: np.ndarray, values: np.ndarray | None, size: int) -> np.ndarray:
    return np.bincount(key, values, size).astype(np.int64)


def _gradient_histograms(rows: DataFrame, features: int, bins: int, weights: np.ndarray, past: list, trees: list,
                         frontier: list[list[int]], scale: float, residuals=softmax_residuals) -> np.ndarray:
    """(class, place in its frontier, feature, bin, [n, w, g, h]) sums for the frontier's nodes of every class's tree, w, g
    and h in multiples of 1 / scale; h is 0 but for the softmax.

    Rounded to multiples of 1 / scale, sums do not depend on their order. At most classes x 2^depth x features x bins
    rows reach the driver."""
    width, curved = max(map(len, frontier)), residuals is softmax_residuals
    shape = (CLASSES, width, features, bins)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, *shape), np.int64)
        for x, y, raw in _scored_blocks(batches, features):
            every, w = residuals(y, raw_scores(raw, x, past)), weights[y]
            flags = [f for f in range(features) if bins > 1 and x[:, f].max() <= 1]
            wide = [f for f in range(features) if f not in flags]
            # of flags, only the ones are counted, all flags at once
            ones = [np.flatnonzero(x[:, f]) for f in flags]
            on, flag = np.concatenate([*ones, np.zeros(0, np.int64)]), np.repeat(np.arange(len(flags)), list(map(len, ones)))
            for c in range(CLASSES):
                place = np.full(len(trees[c]["feature"]), -1)
                place[frontier[c]] = np.arange(len(frontier[c]))
                # rows of no frontier node are counted behind the others
                at = place[descend_small(trees[c], x)]
                at[at < 0] = width
                r = every[:, c]
                parts = [None, np.rint(w * scale), np.rint(w * r * scale)]
                if curved:
                    parts.append(np.rint(w * np.abs(r) * (1 - np.abs(r)) * scale))
                whole = [_sums(at, v, width + 1)[:width] for v in parts]
                key = at.take(on) * len(flags) + flag
                for k, v in enumerate(parts if flags else ()):
                    set_ = _sums(key, None if v is None else v.take(on), (width + 1) * len(flags)).reshape(width + 1, -1)[:width]
                    total[k, c][:, flags, 1] += set_
                    total[k, c][:, flags, 0] += whole[k][:, None] - set_
                for f in wide:
                    key = at * bins + x[:, f]
                    for k, v in enumerate(parts):
                        total[k, c, :, f] += _sums(key, v, (width + 1) * bins)[:width * bins].reshape(width, bins)
        total = total.reshape(4, -1)
        cells = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(cells), *(pa.array(t[cells]) for t in total)], ["cell", "n", "w", "g", "h"])

    found = rows.mapInArrow(add, "cell long, n long, w long, g long, h long").groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in "nwgh"]).toArrow()
    out = np.zeros((math.prod(shape), 4), np.int64)
    out[found.column("cell").to_numpy()] = np.stack([found.column(c).to_numpy() for c in "nwgh"], axis=1)
    return out.reshape(*shape, 4)


def _boosting_start(n: dict[int, int], w: np.ndarray, one_vs_rest: bool) -> tuple[list[float], float]:
    """The first scores, and what sums are multiples of the inverse of."""
    mass = np.array([n.get(c, 0) * w[c] for c in range(CLASSES)])
    start = [0.0] * CLASSES if one_vs_rest else \
        np.log(np.maximum(mass / max(mass.sum(), 1e-300), np.finfo(np.float32).eps)).tolist()
    # 2^62 holds the largest sum (binary residuals reach 4), and a batch's sums stay exact in doubles
    return start, 2.0 ** min(36, int((59 if one_vs_rest else 61) - math.log2(max(2.0, mass.sum()))))


def _node_value(sums: np.ndarray, scale: float, rate: float, number: int, one_vs_rest: bool) -> float:
    """Of a node with the sums [n, w, g, h] in the round ``number``."""
    _, w, g, h = (float(v) / scale for v in sums)
    if one_vs_rest:
        return (rate if number else 1.0) * g / w if w else 0.0
    return leaf_value(g, h, rate)


def _split_node(tree: dict[str, list], node: int, feature: int, cut: int) -> list[int]:
    """Split a leaf; its children."""
    new = [len(tree["feature"]), len(tree["feature"]) + 1]
    tree["feature"][node], tree["bin"][node], (tree["left"][node], tree["right"][node]) = feature, cut, new
    for _ in new:
        for k, v in _leaf().items():
            tree[k] += v
    return new


def fit_boosting(rows: DataFrame, bins: Bins, weights: list[float], rounds: int = 100, max_depth: int = 3,
                 rate: float = 0.1, min_split: int = 2, min_leaf: int = 1, refresh: int = REFRESH,
                 one_vs_rest: bool = False) -> Boosted:
    """Gradient boosting of ``rows`` (y, b0, ...): multinomial, or of each class against the rest. The latter's first trees
    are fitted to the signs and count in full, as in MLlib."""
    features = len(bins.columns)
    w, begin = np.array(weights), np.append(0, np.cumsum(bins.widths))
    n = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # a row a class
    start, scale = _boosting_start(n, w, one_vs_rest)
    scored = written_once(_scored(rows, features, start), "boosting_rows")
    model = Boosted(bins, start, [], {"n_estimators": rounds, "max_depth": max_depth, "learning_rate": rate}, one_vs_rest)
    past: list[list[dict[str, list]]] = []
    for number in range(rounds):
        residuals = softmax_residuals if not one_vs_rest else binary_residuals if number else signs

        trees, frontier = [_leaf() for _ in range(CLASSES)], [[0] for _ in range(CLASSES)]
        for depth in range(max_depth):
            if not any(frontier):
                break
            hist = _gradient_histograms(scored, features, bins.count, w, past, trees, frontier, scale, residuals)
            ahead: list[list[int]] = [[] for _ in range(CLASSES)]
            for c, t in enumerate(trees):
                if not frontier[c]:
                    continue
                h = np.concatenate([hist[c, :len(frontier[c]), f, :k] for f, k in enumerate(bins.widths)], axis=1)
                found = best_regression_splits(h, begin, scale, min_split, min_leaf)
                for node, f, b, left, sums in zip(frontier[c], *(a.tolist() for a in found[:2]), found[2],
                                                  h[:, :begin[1]].sum(axis=1)):
                    t["value"][node] = _node_value(sums, scale, rate, number, one_vs_rest)
                    if f >= 0:
                        ahead[c] += _split_node(t, node, f, b)
                        for child, part in zip(ahead[c][-2:], (left, sums - left)):
                            t["value"][child] = _node_value(part, scale, rate, number, one_vs_rest)
            frontier = ahead
        model.trees.append(trees)
        past.append(trees)
        if len(past) == refresh:
            scored, past = _refreshed(scored, features, past), []
    return model


SCORED = "x binary, y binary, s binary"


def _scored_batch(x: np.ndarray, y: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a, k).tobytes()], pa.binary()) for a, k in (
        (x.T, np.int16), (y, np.int8), (raw.T, np.float64))], ["x", "y", "s"])


def _scored_blocks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[tuple]:
    """(x, y, scores) of every block of BLOCK_ROWS rows at most."""
    for b in batches:
        for x, y, raw in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("x", "y", "s"))):
            yield (np.frombuffer(x, np.int16).reshape(features, -1).T, np.frombuffer(y, np.int8).astype(np.int64),
                   np.frombuffer(raw, np.float64).reshape(CLASSES, -1).T)


def _scored(rows: DataFrame, features: int, start: list[float]) -> DataFrame:
    """``rows`` (y, b0, ...) in blocks, every row with the scores ``start``."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BLOCK_ROWS):
                b = whole.slice(lo, BLOCK_ROWS)
                yield _scored_batch(_bins_of(b, features), b.column(b.schema.get_field_index("y")).to_numpy(),
                                    np.tile(start, (b.num_rows, 1)))

    return rows.select("y", *[f"b{i}" for i in range(features)]).mapInArrow(pack, SCORED)


def _refreshed(scored: DataFrame, features: int, past: list) -> DataFrame:
    """``scored`` with the rounds in ``past`` added to its scores, written once."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, raw in _scored_blocks(batches, features):
            yield _scored_batch(x, y, raw_scores(raw, x, past))

    return written_once(scored.mapInArrow(add, SCORED), "boosting_scores")


#: Most cells of a joint code.
JOINT_CELLS = 256


def joint_codes(x: np.ndarray, cells: int = JOINT_CELLS) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
    """The features of ``x`` (features, rows) in groups whose values together take few forms: (features, each row's code,
    bins of the features by code). A feature joins the first group that keeps at most ``cells`` codes."""
    groups: list[list] = []
    for f in sorted(range(len(x)), key=lambda f: (-int(x[f].max(initial=0)), f)):
        width = int(x[f].max(initial=0)) + 1
        for g in groups:
            joint = g[1] * width + x[f]
            present = np.bincount(joint, minlength=g[2].shape[1] * width) > 0
            if present.sum() <= cells:
                old = np.flatnonzero(present)
                g[0].append(f)
                g[1], g[2] = (np.cumsum(present) - 1)[joint], np.concatenate([g[2][:, old // width], old[None] % width])
                break
        else:
            groups.append([[f], x[f].astype(np.int64), np.arange(width)[None]])
    return [tuple(g) for g in groups]


class _LocalBoosting:
    """:func:`fit_boosting` over rows that one task holds: the same sums, so the same trees. Histograms are counted over
    joint codes, of the smaller child of each split only, and rows keep their nodes and scores."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fitted: int, widths: list[int], weights: list[float], rate: float,
                 one_vs_rest: bool, min_split: int = 2, min_leaf: int = 1):
        """``x`` (features, rows); the first ``fitted`` rows are fitted to, the others only scored."""
        self.x, self.y, self.fitted, self.rate, self.one_vs_rest = x, y.astype(np.int64), fitted, rate, one_vs_rest
        self.limits, self.begin = (min_split, min_leaf), np.append(0, np.cumsum(widths))
        w, own = np.array(weights), self.y[:fitted]
        self.start, self.scale = _boosting_start(dict(enumerate(np.bincount(own, minlength=CLASSES).tolist())), w, one_vs_rest)
        self.w, self.unit = w[own], np.rint(w * self.scale).astype(np.int64)
        self.raw = np.tile(np.array(self.start)[:, None], (1, len(y)))
        self.node = np.zeros((CLASSES, len(y)), np.int16)
        self.blocks = [slice(lo, min(lo + BLOCK_ROWS, fitted)) for lo in range(0, fitted, BLOCK_ROWS)]
        self.groups, self.cells = [], []
        for features, code, bins in joint_codes(x[:, :fitted]):
            # the cells of the group's features, and which of them each code counts for
            own_cells = np.concatenate([np.arange(self.begin[f], self.begin[f + 1]) for f in features])
            to = np.concatenate([b[:, None] == np.arange(widths[f]) for f, b in zip(features, bins)], axis=1).astype(np.float64)
            self.groups.append((code * CLASSES + own, bins.shape[1]))
            self.cells.append((own_cells, to))
        self.root = [np.bincount(key, minlength=cells * CLASSES)[None] for key, cells in self.groups]
        self.trees: list[list[dict[str, list]]] = []

    def _cells(self, n: list[np.ndarray], g: list[np.ndarray]) -> np.ndarray:
        """(nodes, cells, [n, w, g]) from the groups' counts and sums (nodes, group's cells x classes)."""
        out = np.zeros((len(n[0]), 3, self.begin[-1]), np.int64)
        for (_, cells), (own, to), a, b in zip(self.groups, self.cells, n, g):
            a, b = a.reshape(len(a), cells, CLASSES), b.reshape(len(b), cells, CLASSES)
            sums = np.stack([a.sum(axis=2), a @ self.unit, b.sum(axis=2)], axis=2).swapaxes(1, 2)
            # whole numbers, exact in doubles in two halves
            out[..., own] = ((sums >> 31).astype(np.float64) @ to).astype(np.int64) * (1 << 31) \
                + ((sums & (1 << 31) - 1).astype(np.float64) @ to).astype(np.int64)
        return out.swapaxes(1, 2)

    def _residuals(self, number: int) -> tuple[np.ndarray, np.ndarray | None]:
        """Weighted residuals and curvatures of the fitted rows, in multiples of 1 / scale."""
        g = np.empty((CLASSES, self.fitted))
        h = None if self.one_vs_rest else np.empty((CLASSES, self.fitted))
        residuals = softmax_residuals if not self.one_vs_rest else binary_residuals if number else signs
        for b in self.blocks:
            w = self.w[b]
            if self.one_vs_rest:
                every = residuals(self.y[b], self.raw[:, b].T).T
            else:
                e = np.exp(self.raw[:, b] - self.raw[:, b].max(axis=0))
                every = (self.y[b] == np.arange(CLASSES)[:, None]) - e / e.sum(axis=0)
            for c, r in enumerate(every):
                g[c, b] = np.rint(w * r * self.scale)
                if h is not None:
                    size = np.abs(r)
                    h[c, b] = np.rint(w * size * (1 - size) * self.scale)
        return g, h

    def _moved(self, c: int, rows: slice, splits: list[tuple]) -> np.ndarray:
        node = self.node[c, rows]
        for at, f, b, left in splits:
            node += (node == at) * ((self.x[f, rows] > b) + np.int16(left - at))
        return node

    def _below(self, c: int, g: np.ndarray, h: np.ndarray | None, splits: list[tuple], small: list[int],
               last: bool) -> tuple[list, list, np.ndarray]:
        """Move the rows of a class's tree below its new splits; counts and sums of the ``small`` children, and their h."""
        place = np.full(max(v[3] for v in splits) + 2, -1)
        place[small] = np.arange(len(small))
        n, sums = ([np.zeros((len(small), cells * CLASSES), np.int64) for _, cells in self.groups] for _ in range(2))
        curved = np.zeros(len(small), np.int64)
        for b in self.blocks:
            slot = place.take(self._moved(c, b, splits))
            rows = np.flatnonzero(slot >= 0)
            slot = slot.take(rows)
            if h is not None:
                curved += np.bincount(slot, h[c, b].take(rows), len(small)).astype(np.int64)
            if last:
                continue
            part = g[c, b].take(rows)
            for i, (key, cells) in enumerate(self.groups):
                size = cells * CLASSES
                key = key[b].take(rows) + slot * size
                n[i] += np.bincount(key, minlength=len(small) * size).reshape(-1, size)
                sums[i] += np.bincount(key, part, len(small) * size).astype(np.int64).reshape(-1, size)
        self._moved(c, slice(self.fitted, None), splits)
        return n, sums, curved

    def round(self, max_depth: int) -> None:
        number = len(self.trees)
        g, h = self._residuals(number)
        trees = [_leaf() for _ in range(CLASSES)]
        self.node[:] = 0
        held = []  # of every open node: class, number, counts and sums by group, h
        for c in range(CLASSES):
            sums = [sum(np.bincount(key[b], g[c, b], cells * CLASSES).astype(np.int64) for b in self.blocks)[None]
                    for key, cells in self.groups]
            held.append((c, [0], self.root, sums, np.array([0 if h is None else sum(int(h[c, b].sum()) for b in self.blocks)])))
        for depth in range(max_depth):
            held = [v for v in held if v[1]]
            if not held:
                break
            hist = self._cells(*([np.concatenate([v[k][i] for v in held]) for i in range(len(self.groups))] for k in (2, 3)))
            found = best_regression_splits(hist, self.begin, self.scale, *self.limits)
            total, first, ahead = hist[:, :self.begin[1]].sum(axis=1), 0, []
            for c, nodes, n, sums, curved in held:
                t, mine = trees[c], range(first, first + len(nodes))
                first += len(nodes)
                for node, i, bent in zip(nodes, mine, curved):
                    t["value"][node] = _node_value([*total[i], bent], self.scale, self.rate, number, self.one_vs_rest)
                split = [(k, i) for k, i in enumerate(mine) if found[0][i] >= 0]
                if not split:
                    continue
                children = [_split_node(t, nodes[k], int(found[0][i]), int(found[1][i])) for k, i in split]
                lefts, sizes = [found[2][i] for _, i in split], [total[i] for _, i in split]
                less = [int(a[0] * 2 > s[0]) for a, s in zip(lefts, sizes)]  # 1: the right child has fewer rows
                below = self._below(c, g, h, [(nodes[k], t["feature"][nodes[k]], t["bin"][nodes[k]], new[0])
                                              for (k, _), new in zip(split, children)],
                                    [new[side] for new, side in zip(children, less)], depth + 1 == max_depth)
                up = [k for k, _ in split]
                both = [[np.empty((2 * len(up), a.shape[1]), np.int64) for a in v] for v in below[:2]]
                bent = np.empty(2 * len(up), np.int64)
                own = 2 * np.arange(len(up)) + less
                for of, parents, out in ((below[0], n, both[0]), (below[1], sums, both[1]), ([below[2]], [curved], [bent])):
                    for a, p, o in zip(of, parents, out):
                        o[own], o[own ^ 1] = a, p[up] - a
                for k, (new, left, whole) in enumerate(zip(children, lefts, sizes)):
                    for side, part in enumerate((left, whole - left)):
                        t["value"][new[side]] = _node_value([*part, bent[2 * k + side]], self.scale, self.rate, number,
                                                            self.one_vs_rest)
                ahead.append((c, [i for new in children for i in new], *both, bent))
            held = ahead
        for c, t in enumerate(trees):
            self.raw[c] += np.array(t["value"]).take(self.node[c])
        self.trees.append(trees)

    def right(self) -> list[tuple[int, int, int]]:
        """(class, right predictions, rows) of the rows that were not fitted to."""
        y = self.y[self.fitted:]
        ok = self.raw[:, self.fitted:].argmax(axis=0) == y
        return [(c, int(ok[y == c].sum()), int((y == c).sum())) for c in np.unique(y).tolist()]


def _side_by_side(spark: SparkSession, n: int) -> list[int]:
    """Keys whose rows a shuffle to n partitions deals to the partitions 0, 1, ..., one each."""
    ids = spark.range(100 * n).select(F.col("id").cast("int").alias("k"))
    found = {r.p: r.k for r in ids.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()}
    rest = iter(range(100 * n, 101 * n))  # a row a partition; of one that got none, any key
    return [found[p] if p in found else next(rest) for p in range(n)]


def _boosted_locally(rows: DataFrame, bins: Bins, weights: list[float], fits: list[dict]) -> list[dict]:
    """Every one of ``fits`` (rounds, max_depth, rate, one_vs_rest, and for cross-validation the fold ``out`` and the
    ``lengths`` at which it is scored) by a task of its own: its start and trees, or the right predictions."""
    features, kind, widths, spark = len(bins.columns), _x_kind(bins.count), bins.widths, rows.sparkSession
    # the longest first
    order = sorted(range(len(fits)), key=lambda i: (-fits[i]["rounds"] * fits[i]["max_depth"], i))
    by_key = {k: i for k, i in zip(_side_by_side(spark, len(fits)), order)}
    kinds = [(kind, features), (np.int8, 1), (np.int32, 1)]
    folded = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(-1))

    def run(t: pa.Table) -> pa.Table:
        key = t.column("fit")[0].as_py()
        fit = fits[by_key[key]]
        found = [_unpacked(v.as_buffer(), n, kinds) for n, v in zip(t.column("n").to_pylist(), t.column("data"))]
        x, y, fold = (np.concatenate([f[i].reshape(w, -1) for f in found], axis=1) for i, (_, w) in enumerate(kinds))
        del found
        apart = fold[0] == fit.get("out", -2)
        at = np.argsort(apart, kind="stable")
        model = _LocalBoosting(x.take(at, axis=1), y[0].take(at), int((~apart).sum()), widths, weights, fit["rate"],
                               fit["one_vs_rest"])
        right = {}
        for number in range(1, fit["rounds"] + 1):
            model.round(fit["max_depth"])
            if number in fit.get("lengths", ()):
                right[number] = model.right()
        doc = {"right": right} if right else {"start": model.start, "trees": model.trees}
        return pa.table({"fit": pa.array([by_key[key]], pa.int32()), "doc": pa.array([json.dumps(doc)], pa.string())})

    blocks = _in_blocks(folded.select("y", "fold", *_bin_names(bins)), features, kind, {"fold": np.int32})
    dealt = blocks.select(F.explode(F.array(*[F.lit(k) for k in by_key])).alias("fit"), "n", "data")
    found = dealt.repartition(len(fits), "fit").groupBy("fit").applyInArrow(run, "fit int, doc string").collect()  # a row a fit
    docs = {r.fit: json.loads(r.doc) for r in found}
    return [docs[i] for i in range(len(fits))]


def boosted(rows: DataFrame, bins: Bins, weights: list[float], rounds: int = 100, max_depth: int = 3, rate: float = 0.1,
            one_vs_rest: bool = False) -> Boosted:
    """:func:`fit_boosting`; of few rows, by one task instead of a job for every level of every round."""
    if 0 < rows.count() <= TASK_ROWS:
        fit = {"rounds": rounds, "max_depth": max_depth, "rate": rate, "one_vs_rest": one_vs_rest}
        doc = _boosted_locally(rows, bins, weights, [fit])[0]
        return Boosted(bins, doc["start"], doc["trees"],
                       {"n_estimators": rounds, "max_depth": max_depth, "learning_rate": rate}, one_vs_rest)
    return fit_boosting(rows, bins, weights, rounds, max_depth, rate, one_vs_rest=one_vs_rest)


# ---- grids ----------------------------------------------------------------------------------------------------

def _macro_recall(counts: DataFrame, points: int) -> list[float]:
    """Mean over folds of the mean class recall, from (point, fold, y, ok, n)."""
    by: dict[tuple[int, int], list[float]] = {}
    for r in counts.collect():  # points x folds x classes rows
        by.setdefault((r.point, r.fold), []).append(r.ok / r.n)
    folds: dict[int, list[float]] = {}
    for (point, _), recalls in sorted(by.items()):
        folds.setdefault(point, []).append(sum(recalls) / len(recalls))
    return [sum(folds[p]) / len(folds[p]) if p in folds else 0.0 for p in range(points)]


def _held_out(rows: DataFrame, features: int, points: int, predict) -> DataFrame:
    """(point, fold, y, ok, n): right predictions of rows outside their fold's fits; ``predict(fold, x)`` gives class codes
    (points, rows)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y, folds = _bins_of(b, features), b.column("y").to_numpy(), b.column("fold").to_numpy()
            out = []
            for fold in np.unique(folds):
                at = np.flatnonzero(folds == fold)
                ok = predict(int(fold), x[at]) == y[at]
                out += [(p, int(fold), c, int(ok[p][y[at] == c].sum()), int((y[at] == c).sum()))
                        for p in range(points) for c in np.unique(y[at]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["point", "fold", "y", "ok", "n"])

    return rows.mapInArrow(score, "point int, fold int, y int, ok long, n long") \
        .groupBy("point", "fold", "y").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n"))


def search_trees(folded: DataFrame, columns: list[str], grid: dict[str, list], folds: int = 5, key: str = "operation_id",
                 forest: bool = False, seed: int = 42, local_rows: int | None = None) -> tuple[list[dict], list[float]]:
    """Macro recall in cross-validation of every point of the grid: n_estimators (forests), max_depth, min_samples_split,
    min_samples_leaf. Only a leaf's least rows and the folds need fits of their own, all grown together; the other axes
    are cuts of these."""
    points = [dict(zip(grid, v)) for v in product(*grid.values())]
    leaf_sizes = sorted({p.get("min_samples_leaf", 1) for p in points})
    trees = max(p.get("n_estimators", 1) for p in points)
    kind = folded.schema[key].dataType.simpleString()
    rows, bins = binned_training(folded, columns, {key: kind, "fold": "int"})
    weights = class_weights(folded)  # folds are stratified
    tried = max(1, int(math.sqrt(len(columns)))) if forest else None
    # tree number = (leaf size x folds + fold) x trees + tree: every fold's fit sees the other folds' rows
    if forest and 0 < rows.count() <= TASK_ROWS:
        return points, _local_forests(rows, bins, weights, points, leaf_sizes, folds, trees, tried, seed, key)
    local_rows = local_rows or (FOREST_ROWS if forest else LOCAL_ROWS)
    left = [i % folds for i in range(len(leaf_sizes) * folds)]
    copies, sizes = draws(rows, len(columns), bins.count, trees, seed, key, left) if forest \
        else left_out(rows, len(columns), bins.count, left)
    params = {t: TreeParams(None, 2, leaf_sizes[t // (folds * trees)], tried, seed)
              for t in range(len(leaf_sizes) * folds * trees)}
    model = TreeModel(grow(copies, len(columns), bins.count, weights, params, local_rows, sizes, bins.widths), bins, weights)
    if trees == 1:
        return points, _cut_recalls(model, rows, points, leaf_sizes, folds)
    votes_of = {}
    for i, leaf in enumerate(leaf_sizes):
        mine = [j for j, p in enumerate(points) if p.get("min_samples_leaf", 1) == leaf]
        first = i * folds * trees
        own = TreeModel(model.table.where((F.col("tree") >= first) & (F.col("tree") < first + folds * trees))
                        .withColumn("tree", F.col("tree") - first), bins, weights)
        votes_of.update(_cut_scores(own, rows, len(columns), [points[j] for j in mine], mine, trees, weights))
    return points, [votes_of[i] for i in range(len(points))]


def _cut_recalls(model: TreeModel, rows: DataFrame, points: list[dict], leaf_sizes: list[int], folds: int) -> list[float]:
    """Of one tree a fold and leaf size (numbers as in :func:`search_trees`): the points' recalls. A held-out row meets the
    part of each tree of its fold that it falls into; cuts above the part are decided on its way there."""
    cuts = sorted({(p.get("max_depth"), p.get("min_samples_split", 2)) for p in points}, key=str)
    numbers = {(c, leaf): [i for i, p in enumerate(points) if p.get("min_samples_leaf", 1) == leaf
                           and (p.get("max_depth"), p.get("min_samples_split", 2)) == c] for c in cuts for leaf in leaf_sizes}
    parts, names, w = _Parts(model), _bin_names(model.bins), np.array(model.class_weights)
    total = parts.counts.sum(axis=1)
    ends = [(total < least) | (False if depth is None else parts.depth >= depth) for depth, least in cuts]
    mass = parts.counts * w
    code = (mass / np.where(len(mass), mass.sum(axis=1, keepdims=True), 1)).argmax(axis=1)
    features, kind, tree_of = len(names), _x_kind(model.bins.count), parts.tree_of
    kinds = [(kind, features), (np.int8, 1), (np.int8, len(cuts))]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, fold, y = _bins_of(b, features), b.column("fold").to_numpy(), b.column("y").to_numpy()
            for leaf in range(len(leaf_sizes)):
                done, out = np.full((len(cuts), len(x)), -1, np.int8), []

                def passes(at: np.ndarray, nodes: np.ndarray) -> None:
                    for i, end in enumerate(ends):
                        new = end[nodes] & (done[i, at] < 0)
                        done[i, at[new]] = code[nodes[new]]

                part = parts.part(leaf * folds + fold.astype(np.int64), x, passes)
                order = np.argsort(part, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                    out.append((int(part[own[0]]), len(own), _packed(x[own].T.astype(kind), y[own].astype(np.int8), done[:, own])))
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in out], k) for i, k in enumerate(
                    (pa.int32(), pa.int32(), pa.binary()))], ["part", "n", "data"])

    def score(part: int, tree: Tree, own: pa.Table) -> pa.Table:
        leaf, fold = divmod(tree_of[part], folds)
        found = [_unpacked(v.as_buffer(), n, kinds) for n, v in zip(own.column("n").to_pylist(), own.column("data"))]
        x, y, above = (np.concatenate([f[i].reshape(w, -1) for f in found], axis=1) for i, (_, w) in enumerate(kinds))
        y, share = y[0], tree.counts * w
        best = (share / share.sum(axis=1, keepdims=True)).argmax(axis=1)
        out = []
        for c, early, late in zip(cuts, above, best[tree.leaves(np.ascontiguousarray(x.T), cuts)]):
            ok = np.where(early >= 0, early, late) == y
            out += [(p, fold, k, int(ok[y == k].sum()), int((y == k).sum())) for p in numbers[c, leaf_sizes[leaf]]
                    for k in np.unique(y).tolist()]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(
            (("point", pa.int32()), ("fold", pa.int32()), ("y", pa.int32()), ("ok", pa.int64()), ("n", pa.int64())))})

    sent = rows.select("fold", "y", *names).mapInArrow(send, "part int, n int, data binary")
    counts = parts.meet(model, sent, score, "point int, fold int, y int, ok long, n long")
    return _macro_recall(counts.groupBy("point", "fold", "y").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")), len(points))


#: Trees of a forest's fit that one task grows and scores.
TASK_TREES = 50


def _local_forests(rows: DataFrame, bins: Bins, weights: list[float], points: list[dict], leaf_sizes: list[int], folds: int,
                   trees: int, tried: int, seed: int, key: str) -> list[float]:
    """The points' recalls where a task holds all rows: it draws and grows some trees of a fold's fit, one at a time, and
    adds up their shares of the rows that the fit leaves out, for every cut. Neither copies of rows nor trees are stored."""
    cuts = sorted({(p.get("max_depth"), p.get("min_samples_split", 2)) for p in points}, key=str)
    features, kind, spark, w = len(bins.columns), _x_kind(bins.count), rows.sparkSession, np.array(weights)
    lengths = sorted({p.get("n_estimators", 1) for p in points})
    steps = [(lo, min(lo + TASK_TREES, b)) for a, b in zip([0, *lengths], lengths) for lo in range(a, b, TASK_TREES)]
    tasks = [(leaf, fold, lo, hi) for lo, hi in steps for leaf in range(len(leaf_sizes)) for fold in range(folds)]
    by_key = dict(zip(_side_by_side(spark, len(tasks)), tasks))
    kinds = [(kind, features), (np.int8, 1), (np.int64, 1), (np.int32, 1)]
    numbers = {(p.get("max_depth"), p.get("min_samples_split", 2), p.get("min_samples_leaf", 1), p.get("n_estimators", 1)): i
               for i, p in enumerate(points)}

    def run(t: pa.Table) -> pa.Table:
        leaf, out, first, end = by_key[t.column("fit")[0].as_py()]
        found = [_unpacked(v.as_buffer(), n, kinds) for n, v in zip(t.column("n").to_pylist(), t.column("data"))]
        x, y, start, fold = (np.concatenate([f[i].reshape(k, -1) for f in found], axis=1) for i, (_, k) in enumerate(kinds))
        del found
        y, start, fold = y[0], start[0], fold[0]
        apart = np.flatnonzero(fold == out)
        apart = apart[np.lexsort((y[apart], start[apart]))]  # the same order in all tasks
        held, fitted = np.ascontiguousarray(x[:, apart].T), np.flatnonzero(fold != out)
        params = TreeParams(None, 2, leaf_sizes[leaf], tried, seed)
        sums = np.zeros((len(cuts), CLASSES, len(apart)), np.int64)
        for number in range(first, end):
            m = drawn(start[fitted], number)
            own = np.flatnonzero(m)
            at = fitted[own]
            if not len(at):
                continue
            tree = Tree(*grown_subtree(x.take(at, axis=1).T, y[at], m[own], bins.count, w, params,
                                       (leaf * folds + out) * trees + number, ""))
            share = tree.counts * w
            share = np.rint(share / share.sum(axis=1, keepdims=True) * SHARE_SCALE).astype(np.int64).T
            last = tree.leaves(held, [(None, 0)])[0]
            for total, ends in zip(sums, tree.ends(cuts)):
                total += share.take(ends.take(last), axis=1)
        some = [slice(lo, lo + SUM_ROWS) for lo in range(0, len(apart), SUM_ROWS)]
        blocks = [(leaf, out, i, first, len(apart[b]), _packed(y[apart[b]], sums[:, :, b])) for i, b in enumerate(some)]
        return pa.table({c: pa.array([v[i] for v in blocks], pa.binary() if c == "data" else pa.int32())
                         for i, c in enumerate(("leaf", "fold", "block", "first", "n", "data"))})

    def add(t: pa.Table) -> pa.Table:
        leaf, fold = (t.column(c)[0].as_py() for c in ("leaf", "fold"))
        total, out, ends = 0, [], dict(steps)
        for first, n, data in sorted(zip(*(t.column(c).to_pylist() for c in ("first", "n", "data")))):
            y, sums = _unpacked(data, n, [(np.int8, 1), (np.int64, len(cuts) * CLASSES)])
            total = total + sums.reshape(len(cuts), CLASSES, n)
            for cut, ok in zip(cuts, total.argmax(axis=1) == y):
                point = numbers.get((*cut, leaf_sizes[leaf], ends[first]))
                if point is not None:
                    out += [(point, fold, c, int(ok[y == c].sum()), int((y == c).sum())) for c in np.unique(y).tolist()]
        return pa.table({n: pa.array([r[i] for r in out], k) for i, (n, k) in enumerate(
            (("point", pa.int32()), ("fold", pa.int32()), ("y", pa.int32()), ("ok", pa.int64()), ("n", pa.int64())))})

    blocks = _in_blocks(_hashed(rows, features, seed, key, F.col("fold")), features, kind, {"h": np.int64, "fold": np.int32})
    dealt = blocks.select(F.explode(F.array(*[F.lit(k) for k in by_key])).alias("fit"), "n", "data")
    sums = dealt.repartition(len(tasks), "fit").groupBy("fit").applyInArrow(
        run, "leaf int, fold int, block int, first int, n int, data binary")
    counts = sums.repartition(_partitions(spark), "leaf", "fold", "block").groupBy("leaf", "fold", "block").applyInArrow(
        add, "point int, fold int, y int, ok long, n long")
    return _macro_recall(counts.groupBy("point", "fold", "y").agg(F.sum("ok").alias("ok"), F.sum("n").alias("n")), len(points))


def _cut_scores(model: TreeModel, rows: DataFrame, features: int, points: list[dict], numbers: list[int], trees: int,
                weights: list[float]) -> dict[int, float]:
    cuts = sorted({(p.get("max_depth"), p.get("min_samples_split", 2)) for p in points}, key=str)
    every = {}
    for group in model.groups():  # one group unless the forests are very large
        every.update(group)
    shared = rows.sparkSession.sparkContext.broadcast(every)
    w = np.array(weights)

    def predict(fold: int, x: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(cuts), len(x), CLASSES))
        out = np.zeros((len(points), len(x)), np.int64)
        for t in range(trees):
            tree = shared.value.get(fold * trees + t)
            if tree is not None:
                share = tree.counts * w
                share = share / share.sum(axis=1, keepdims=True)
                sums += share[tree.leaves(x, cuts)]
            for i, p in enumerate(points):
                if p.get("n_estimators", 1) == t + 1:
                    out[i] = sums[cuts.index((p.get("max_depth"), p.get("min_samples_split", 2)))].argmax(axis=1)
        return out

    recalls = _macro_recall(_held_out(rows, features, len(points), predict), len(points))
    shared.unpersist()
    return dict(zip(numbers, recalls))


def search_boosting(folded: DataFrame, columns: list[str], grid: dict[str, list], folds: int = 5) \
        -> tuple[list[dict], list[float]]:
    """Macro recall in cross-validation of n_estimators (first trees of the longest fit), max_depth and learning_rate."""
    points = [dict(zip(grid, v)) for v in product(*grid.values())]
    rows, bins = binned_training(folded, columns, {"fold": "int"})
    weights = class_weights(folded)
    found: dict[int, float] = {}
    if 0 < rows.count() <= TASK_ROWS:
        return points, _local_grid(rows, bins, weights, points, folds)
    for depth, rate in sorted({(p["max_depth"], p["learning_rate"]) for p in points}):
        mine = [i for i, p in enumerate(points) if (p["max_depth"], p["learning_rate"]) == (depth, rate)]
        most = max(points[i]["n_estimators"] for i in mine)
        fits = {f: fit_boosting(rows.where(F.col("fold") != f), bins, weights, most, depth, rate) for f in range(folds)}
        lengths = [points[i]["n_estimators"] for i in mine]

        def predict(fold: int, x: np.ndarray) -> np.ndarray:
            m = fits[fold]
            return np.stack([raw_scores(np.tile(m.start, (len(x), 1)), x, m.trees[:k]).argmax(axis=1) for k in lengths])

        found.update(zip(mine, _macro_recall(_held_out(rows, len(columns), len(mine), predict), len(mine))))
    return points, [found[i] for i in range(len(points))]


def _local_grid(rows: DataFrame, bins: Bins, weights: list[float], points: list[dict], folds: int) -> list[float]:
    """The points' recalls where each fit is a task's: it scores the fold that it leaves out on the way."""
    lengths: dict[tuple, list[int]] = {}
    for p in points:
        lengths.setdefault((p["max_depth"], p["learning_rate"]), []).append(p["n_estimators"])
    fits = [{"rounds": max(n), "max_depth": depth, "rate": rate, "one_vs_rest": False, "out": f, "lengths": n}
            for (depth, rate), n in sorted(lengths.items()) for f in range(folds)]
    recalls: dict[tuple, list[float]] = {}
    for fit, doc in zip(fits, _boosted_locally(rows, bins, weights, fits)):
        for number, right in doc["right"].items():
            if right:
                recalls.setdefault((fit["max_depth"], fit["rate"], int(number)), []).append(
                    sum(ok / n for _, ok, n in right) / len(right))
    of = (recalls.get((p["max_depth"], p["learning_rate"], p["n_estimators"])) for p in points)
    return [sum(v) / len(v) if v else 0.0 for v in of]


# ---- artefacts ------------------------------------------------------------------------------------------------

def save_model(spark: SparkSession, path: str, model: TreeModel | Boosted) -> None:
    doc = {"columns": model.bins.columns, "cuts": model.bins.cuts, "params": model.params}
    if isinstance(model, TreeModel):
        model.table.write.mode("overwrite").parquet(f"{path}/nodes")
        doc |= {"kind": "subtrees", "class_weights": model.class_weights}
    else:
        doc |= {"kind": "boosting", "start": model.start, "trees": model.trees, "one_vs_rest": model.one_vs_rest}
    spark.createDataFrame([(json.dumps(doc),)], "doc string").coalesce(1).write.mode("overwrite").text(f"{path}/hist")


def load_model(spark: SparkSession, path: str) -> TreeModel | Boosted:
    doc = json.loads(spark.read.text(f"{path}/hist").first()[0])
    bins = Bins(doc["columns"], doc["cuts"])
    if doc["kind"] == "subtrees":
        return TreeModel(spark.read.schema(SUBTREES).parquet(f"{path}/nodes"), bins, doc["class_weights"], doc["params"])
    if doc["kind"] != "boosting":
        raise ValueError(f"a model of kind {doc['kind']}, which is no longer read")
    return Boosted(bins, doc["start"], doc["trees"], doc["params"], doc.get("one_vs_rest", False))
