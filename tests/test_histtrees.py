"""Histogram trees and multinomial boosting against single-node brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlens.operators import histtrees as ht

COLUMNS = ["a", "b", "c", "d"]


def rows(n=1500, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c, d = rng.gauss(0, 1), rng.randint(0, 9), rng.random(), rng.randint(0, 1)
        score = a + 0.4 * b - 2 * d + rng.gauss(0, 0.7)
        out.append((f"op{i}", a, float(b), c, float(d), 0 if score > 3.2 else 1 if score < 1.5 else 2))
    return out


def frame(spark, data, parts=4):
    return spark.createDataFrame(data, "operation_id string, a double, b double, c double, d double, label int") \
        .repartition(parts)


def codes(bins, data):
    return np.array([[sum(v >= t for t in cuts) for v, cuts in zip(r[1:5], bins.cuts)] for r in data])


def brute_tree(x, y, w, depth, p, path=""):
    """CART by trying every split: path -> (feature, bin, counts)."""
    counts = [int((y == c).sum()) for c in range(3)]
    best = None
    if (len(y) >= p.min_samples_split and max(counts) < len(y) and (p.max_depth is None or depth < p.max_depth)):
        for f in range(x.shape[1]):
            for b in range(int(x[:, f].max())):
                left = x[:, f] <= b
                if min(left.sum(), (~left).sum()) < p.min_samples_leaf:
                    continue
                gain = 0.0
                for side in (left, ~left):
                    m = np.array([(y[side] == c).sum() * w[c] for c in range(3)])
                    gain += (m * m).sum() / m.sum()
                if best is None or gain > best[0]:
                    best = gain, f, b
    if best is None:
        return {path: (-1, -1, counts)}
    _, f, b = best
    left = x[:, f] <= b
    return {path: (f, b, counts), **brute_tree(x[left], y[left], w, depth + 1, p, path + "0"),
            **brute_tree(x[~left], y[~left], w, depth + 1, p, path + "1")}


@pytest.mark.parametrize("local_rows,params", [
    (10 ** 6, ht.TreeParams()), (200, ht.TreeParams()), (300, ht.TreeParams(4, 2, 1)), (400, ht.TreeParams(None, 25, 7))])
def test_tree_equals_brute_force(spark, local_rows, params):
    data = rows()
    model = ht.fit_tree(frame(spark, data), COLUMNS, params, local_rows, max_bins=24)
    x, y = codes(model.bins, data), np.array([r[5] for r in data])
    assert max(x.max(axis=0)) < 24 and x[:, 1].max() == 9 and x[:, 3].max() == 1
    w = [len(y) / (3 * (y == c).sum()) for c in range(3)]
    assert model.class_weights == pytest.approx(w)
    want = brute_tree(x, y, np.array(model.class_weights), 0, params)
    got = {r.node: (r.feature, r.bin, r.counts) for r in model.nodes.collect()}
    assert got == want
    if params == ht.TreeParams():
        assert max(map(len, want)) > 8
    scored = {r.operation_id: r for r in model.probabilities(frame(spark, data, 2)).collect()}
    for r, code in zip(data[:200], x):
        path = ""
        while want[path][0] >= 0:
            path += "0" if code[want[path][0]] <= want[path][1] else "1"
        m = np.array(want[path][2]) * model.class_weights
        assert [scored[r[0]][c] for c in ht.PROBABILITIES] == pytest.approx((m / m.sum()).tolist())


def test_depth_and_split_limits_are_cuts_of_the_whole_tree(spark):
    data = rows(800, 8)
    whole = ht.fit_tree(frame(spark, data), COLUMNS, max_bins=16)
    tree = whole.trees(whole.nodes.collect())[0]
    x = codes(whole.bins, data)
    for depth, least in ((None, 15), (3, 2), (6, 60)):
        cut = ht.fit_tree(frame(spark, data), COLUMNS, ht.TreeParams(depth, least), max_bins=16)
        own = cut.trees(cut.nodes.collect())[0]
        a = tree.counts[tree.leaves(x, [(depth, least)])[0]]
        b = own.counts[own.leaves(x, [(None, 0)])[0]]
        assert (a == b).all()


def test_a_tree_deeper_than_thirty(spark):
    """Each split peels off one value: a chain, through both ways of growing."""
    data = [(str(i), float(i), 0.0, 0.0, 0.0, (0, 1)[i % 2]) for i in range(90) for _ in range(2)]
    for local in (10 ** 6, 170):
        model = ht.fit_tree(frame(spark, data), COLUMNS, ht.TreeParams(), local)
        got = model.probabilities(frame(spark, data)).select("label", *ht.PROBABILITIES).collect()
        assert all(r[1 + r.label] == 1.0 for r in got)
    order = list(range(70))
    bits = [(str(i), *[0.0] * 4, 0) for i in order]
    assert ht.fit_tree(frame(spark, bits), COLUMNS).nodes.count() == 1  # one class


def test_forest_is_the_same_on_any_partitions(spark):
    data = rows(700, 5)
    got = []
    for parts, local in ((1, 10 ** 6), (7, 10 ** 6), (3, 250)):
        m = ht.fit_forest(frame(spark, data, parts), COLUMNS, trees=9, local_rows=local, max_bins=16)
        got.append(sorted((r.tree, r.node, r.feature, r.bin, tuple(r.counts)) for r in m.nodes.collect()))
    assert got[0] == got[1] == got[2] and {g[0] for g in got[0]} == set(range(9))
    roots = {g[2] for g in got[0] if g[1] == ""}
    assert len(roots) > 1  # features are drawn
    assert len({sum(g[4]) for g in got[0] if g[1] == ""}) > 1  # rows are drawn
    p = m.probabilities(frame(spark, data)).collect()
    assert all(sum(r[c] for c in ht.PROBABILITIES) == pytest.approx(1) for r in p)
    right = sum(max(range(3), key=lambda c: r[ht.PROBABILITIES[c]]) == r.label for r in p)
    assert right / len(p) > 0.9


def brute_boosting(x, y, w, rounds, depth, rate, min_leaf=1):
    """Raw scores after softmax boosting by explicit loops; (scores, trees as nested tuples)."""
    mass = np.array([(y == c).sum() * w[c] for c in range(3)])
    raw = np.tile(np.log(mass / mass.sum()), (len(y), 1))
    weights = np.array(w)[y]
    every = []
    for _ in range(rounds):
        e = np.exp(raw - raw.max(axis=1, keepdims=True))
        p = e / e.sum(axis=1, keepdims=True)
        new = raw.copy()
        for c in range(3):
            r = (y == c) - p[:, c]

            def build(at, d):
                best = None
                if d < depth and len(at) >= 2:
                    for f in range(x.shape[1]):
                        for b in range(int(x[:, f].max())):
                            left = x[at, f] <= b
                            if min(left.sum(), (~left).sum()) < min_leaf:
                                continue
                            lw, rw = weights[at][left].sum(), weights[at][~left].sum()
                            diff = (weights[at] * r[at])[left].sum() / lw - (weights[at] * r[at])[~left].sum() / rw
                            gain = diff * diff * lw * rw / (lw + rw)
                            if gain > 1e-12 and (best is None or gain > best[0] * (1 + 1e-9)):
                                best = gain, f, b
                if best is None:
                    g, h = (weights[at] * r[at]).sum(), (weights[at] * abs(r[at]) * (1 - abs(r[at]))).sum()
                    value = rate * 2 / 3 * g / h if h > 1e-150 else 0.0
                    new[at, c] += value
                    return value
                _, f, b = best
                left = x[at, f] <= b
                return (f, b, build(at[left], d + 1), build(at[~left], d + 1))

            every.append(build(np.arange(len(y)), 0))
        raw = new
    return raw, every


def nested(t, node=0):
    if t["feature"][node] < 0:
        return t["value"][node]
    return (t["feature"][node], t["bin"][node], nested(t, t["left"][node]), nested(t, t["right"][node]))


def same_trees(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if isinstance(a, tuple):
        return a[:2] == b[:2] and same_trees(a[2], b[2]) and same_trees(a[3], b[3])
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-7)


def test_boosting_equals_brute_force(spark):
    data = rows(2000, 6)
    train = frame(spark, data)
    table, bins = ht.binned_training(train, COLUMNS, max_bins=12)
    w = ht.class_weights(train)
    model = ht.fit_boosting(table, bins, w, rounds=5, max_depth=3, refresh=2)
    x, y = codes(bins, data), np.array([r[5] for r in data])
    raw, trees = brute_boosting(x, y, w, 5, 3, 0.1)
    mine = [nested(t) for trees_of in model.trees for t in trees_of]
    assert len(mine) == len(trees) and all(map(same_trees, mine, trees))
    want = ht.softmax(raw)
    got = {r.operation_id: r for r in model.probabilities(train).collect()}
    for r, p in zip(data, want):
        assert [got[r[0]][c] for c in ht.PROBABILITIES] == pytest.approx(p.tolist(), abs=1e-6)
    # the same model from any partitions, to the last bit
    again = ht.fit_boosting(ht.binned(train.repartition(9).withColumn("y", F.col("label").cast("tinyint")), bins,
                                      {"y": "tinyint"}), bins, w, rounds=5, max_depth=3, refresh=5)
    assert [nested(t) for ts in again.trees for t in ts] == mine


def test_one_shuffle_of_histograms_a_level(spark):
    """Only (cell, sums) rows cross the exchange."""
    table, bins = ht.binned_training(frame(spark, rows(300)), COLUMNS, max_bins=8)
    seen = []
    plain = ht._gradient_histograms

    def counted(*a, **k):
        seen.append(1)
        return plain(*a, **k)

    ht._gradient_histograms = counted
    try:
        ht.fit_boosting(table, bins, [1.0] * 3, rounds=2, max_depth=3)
    finally:
        ht._gradient_histograms = plain
    assert len(seen) == 6  # rounds x levels, whatever the number of classes


def test_whole_grids_and_artefacts(spark, tmp_path):
    data = rows(600, 9)
    folded = frame(spark, data).withColumn("fold", F.pmod(F.xxhash64("operation_id"), F.lit(3)).cast("int"))
    grid = {"max_depth": [None, 2, 5], "min_samples_split": [2, 40], "min_samples_leaf": [1, 6]}
    points, recalls = ht.search_trees(folded, COLUMNS, grid, folds=3)
    assert len(points) == 12 and all(0.3 < r <= 1 for r in recalls)
    # a point's value by fits of its own
    i = points.index({"max_depth": 5, "min_samples_split": 40, "min_samples_leaf": 6})
    bins = ht.fit_bins(folded, COLUMNS)
    w, total = np.array(ht.class_weights(folded)), 0.0
    folds = {r.operation_id: r.fold for r in folded.select("operation_id", "fold").collect()}
    for fold in range(3):
        x, y = codes(bins, [r for r in data]), np.array([r[5] for r in data])
        inside = np.array([folds[r[0]] != fold for r in data])
        tree = brute_tree(x[inside], y[inside], w, 0, ht.TreeParams(5, 40, 6))
        hit = {c: [] for c in range(3)}
        for code, label in zip(x[~inside], y[~inside]):
            path = ""
            while tree[path][0] >= 0:
                path += "0" if code[tree[path][0]] <= tree[path][1] else "1"
            hit[label].append(int(np.argmax(np.array(tree[path][2]) * w) == label))
        total += np.mean([np.mean(v) for v in hit.values() if v])
    assert recalls[i] == pytest.approx(total / 3)
    fp, fr = ht.search_trees(folded, COLUMNS, {"n_estimators": [2, 5], "max_depth": [None, 3], "min_samples_split": [2]},
                             folds=3, forest=True)
    assert len(fp) == 4 and min(fr) > 0.4
    bp, br = ht.search_boosting(folded, COLUMNS, {"n_estimators": [1, 3], "max_depth": [2], "learning_rate": [0.1, 0.5]}, 3)
    assert len(bp) == 4 and min(br) > 0.4
    for k, model in enumerate((ht.fit_forest(folded, COLUMNS, 3), ht.fit_boosting(
            *ht.binned_training(folded, COLUMNS), ht.class_weights(folded), rounds=2))):
        ht.save_model(spark, f"{tmp_path}/{k}", model)
        back = ht.load_model(spark, f"{tmp_path}/{k}")
        one, two = (sorted(map(tuple, m.probabilities(folded.select("operation_id", *COLUMNS)).collect()))
                    for m in (model, back))
        assert one == two


def test_large_trees_are_scored_by_parts(spark, monkeypatch):
    """No whole tree reaches the driver or a task, and every probability is that of the whole model."""
    data = rows(900, 11)
    train = frame(spark, data)
    for model in (ht.fit_tree(train, COLUMNS, max_bins=32), ht.fit_forest(train, COLUMNS, trees=5, max_bins=32)):
        whole = {r.operation_id: r for r in model.probabilities(train).collect()}
        with monkeypatch.context() as m:
            m.setattr(ht, "SCORING_NODES", 10)
            m.setattr(ht, "PART_ROWS", 120)
            m.setattr(ht.TreeModel, "groups", lambda self: pytest.fail("the whole model was collected"))
            got = model.probabilities(train).collect()
        assert len(got) == len(whole) == 900
        for r in got:
            assert [r[c] for c in COLUMNS] == [whole[r.operation_id][c] for c in COLUMNS]
            assert [r[c] for c in ht.PROBABILITIES] == pytest.approx([whole[r.operation_id][c] for c in ht.PROBABILITIES],
                                                                     abs=1e-12)


def test_tree_grid_by_parts(spark, monkeypatch):
    """Cuts above a part, at its root and below it; all fits of the grid are grown together."""
    data = rows(700, 12)
    folded = frame(spark, data).withColumn("fold", F.pmod(F.xxhash64("operation_id"), F.lit(3)).cast("int"))
    grid = {"max_depth": [None, 1, 3, 6], "min_samples_split": [2, 30, 200], "min_samples_leaf": [1, 5]}
    grown, plain = [], ht.grow
    monkeypatch.setattr(ht, "grow", lambda *a, **k: grown.append(1) or plain(*a, **k))
    points, whole = ht.search_trees(folded, COLUMNS, grid, folds=3)
    assert len(grown) == 1
    monkeypatch.setattr(ht, "PART_ROWS", 60)
    assert ht.search_trees(folded, COLUMNS, grid, folds=3) == (points, pytest.approx(whole))
    rows_of, bins = ht.binned_training(folded, COLUMNS, {"operation_id": "string", "fold": "int"})
    w = ht.class_weights(folded)
    mine = [i for i, p in enumerate(points) if p["min_samples_leaf"] == 5]
    copies = rows_of.withColumn("m", F.lit(1)).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(2)))).where("tree != fold")
    own = ht.TreeModel(plain(copies, 4, bins.count, w, dict.fromkeys(range(3), ht.TreeParams(None, 2, 5))), bins, w)
    want = ht._cut_scores(own, rows_of, 4, [points[i] for i in mine], mine, 1, w)
    assert [whole[i] for i in mine] == pytest.approx([want[i] for i in mine])


def test_rows_are_stored_anew_once_in_several_levels(spark, monkeypatch):
    """A chain of splits: levels cost a pass over the rows, not a written copy of them each."""
    data = [(str(i), float(i), 0.0, 0.0, 0.0, (0, 1)[i % 2]) for i in range(60) for _ in range(3)]
    written, plain = [], ht.written_once
    monkeypatch.setattr(ht, "written_once", lambda df, name: written.append(name) or plain(df, name))
    model = ht.fit_tree(frame(spark, data), COLUMNS, ht.TreeParams(), 90)
    assert model.nodes.count() == 119
    levels = model.nodes.where("feature >= 0 and aggregate(counts, 0L, (a, x) -> a + x) > 90").selectExpr(
        "max(length(node)) + 1").first()[0]
    assert levels > ht.STORED_LEVELS and 0 < written.count("tree_rows") <= -(-levels // ht.STORED_LEVELS)


@pytest.mark.parametrize("params", [dict(), dict(max_features=2), dict(max_features=1, min_samples_leaf=3, min_samples_split=9)])
def test_levels_at_once_equal_a_node_at_a_time(params):
    rng = np.random.default_rng(4)
    x = np.stack([rng.integers(0, 200, 900), rng.integers(0, 5, 900), rng.integers(0, 2, 900), np.zeros(900, int),
                  rng.integers(0, 60, 900)], axis=1).astype(np.int16)
    y, m, w, p = rng.choice(3, 900, p=[.1, .6, .3]), rng.integers(1, 4, 900), np.array([3.3, .6, 1.1]), ht.TreeParams(**params)
    want, todo = {}, [("01", np.arange(900))]
    while todo:
        path, at = todo.pop()
        hist = np.zeros((1, 5, 200, 3), np.int64)
        ht.add_histogram(hist, np.zeros(len(at), np.int64), x[at], y[at], m[at])
        counts = np.bincount(y[at], m[at], 3).astype(int)
        f, b = ht.best_split(hist[0], w, p, ht.feature_order(5, p, 3, path)) if ht.splittable(counts, len(path), p) else (-1, -1)
        want[path] = (f, b, counts.tolist())
        if f >= 0:
            todo += [(path + "0", at[x[at, f] <= b]), (path + "1", at[x[at, f] > b])]
    got = ht.grow_locally(x, y, m, 200, w, p, 3, "01")
    assert {r["node"]: (r["feature"], r["bin"], r["counts"]) for r in got.to_pylist()} == want and len(want) > 50


def test_passes_of_boosting_read_blocks(spark, monkeypatch):
    """A pass over the training rows reads a few arrays a block, not a field for every bin of every row."""
    table, bins = ht.binned_training(frame(spark, rows(400)), COLUMNS, max_bins=8)
    seen, plain = [], ht._gradient_histograms
    monkeypatch.setattr(ht, "_gradient_histograms", lambda r, *a: seen.append((r.columns, r.count())) or plain(r, *a))
    ht.fit_boosting(table, bins, [1.0] * 3, rounds=3, max_depth=1, refresh=2)
    assert len(seen) == 3 and all(c == ["x", "y", "s"] and n <= 4 for c, n in seen)


def test_bootstrap_draws_are_blocks_and_those_of_the_hash(spark):
    """Draws equal Spark's hash of key, row and tree; a task gives a block a tree, not a row for every draw."""
    data = rows(400, 6)
    table, _ = ht.binned_training(frame(spark, data, 2), COLUMNS, {"operation_id": "string"}, 16)
    blocks, sizes = ht.bootstrapped(table, 4, 5, 42, "operation_id")
    got = blocks.collect()
    assert blocks.columns == ["node", "x", "y", "m", "at"] and len(got) <= 5 * table.rdd.getNumPartitions()
    row_hash = F.xxhash64(F.lit(42), *[F.col(c) for c in table.columns])
    u = F.pmod(F.xxhash64(row_hash, F.col("operation_id"), F.col("tree")), F.lit(1 << 53)) / float(1 << 53)
    chances = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(i + 1)) for i in range(12)]
    want = table.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(4)))).select(
        "tree", sum(((u > c).cast("int") for c in chances), F.lit(0)).alias("m"), "y", *[f"b{i}" for i in range(4)])
    want = sorted(tuple(r) for r in want.where("m > 0").collect())
    found = []
    for r in got:
        y, m, at = (np.frombuffer(r[c], ht.KINDS[c]) for c in ("y", "m", "at"))
        found += zip(at.tolist(), m.tolist(), y.tolist(), *np.frombuffer(r.x, np.int16).reshape(4, -1).tolist())
    assert sorted(found) == want
    assert sizes == {t: sum(w[1] for w in want if w[0] == t) for t in range(5)}


def test_rows_meet_a_part_in_blocks(spark, monkeypatch):
    """Scoring by parts sends arrays of rows to a part, not a row for every tree."""
    train = frame(spark, rows(500, 9))
    model = ht.fit_forest(train, COLUMNS, trees=4, max_bins=16)
    seen, plain = [], ht._Parts.meet
    monkeypatch.setattr(ht, "SCORING_NODES", 10)
    monkeypatch.setattr(ht._Parts, "meet", lambda self, m, sent, *a: seen.append(
        (sent.columns, sent.count())) or plain(self, m, sent, *a))
    assert model.probabilities(train).count() == 500
    assert seen[0][0] == ["part", "x", "at"] and seen[0][1] <= 4 * 8


def test_packed_and_plain_order_agree():
    rng = np.random.default_rng(2)
    key, y, m = rng.integers(0, 50, 300), rng.integers(0, 3, 300), rng.integers(1, 9, 300).astype(float)
    sums = []
    for shift in (0, 57):  # the latter leaves no room for y and m
        k, a, b = ht._in_order(key << shift, y, m)
        assert (np.diff(k) >= 0).all()
        sums.append(np.bincount((k >> shift) * 3 + a, b, 150).tolist())
    assert sums[0] == sums[1] == np.bincount(key * 3 + y, m, 150).tolist()


def test_one_vs_rest_is_mllibs_boosting_in_common_passes(spark, monkeypatch):
    """The probabilities are those of MLlib's OneVsRest(GBTClassifier); the classes' trees share the passes."""
    from pyspark.ml.classification import GBTClassifier, OneVsRest
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    # few values, so that both cut the features at the same places
    train = frame(spark, rows(600, 21)).withColumns(
        {c: F.greatest(F.lit(-1.5), F.least(F.lit(9.0), F.floor(F.col(c) * 2) / 2)) for c in COLUMNS}).withColumn(
        "a", F.least("a", F.lit(1.5))).cache()
    w = ht.class_weights(train)
    table, bins = ht.binned_training(train, COLUMNS)
    passes, plain = [], ht._gradient_histograms
    monkeypatch.setattr(ht, "_gradient_histograms", lambda *a: passes.append(1) or plain(*a))
    model = ht.fit_boosting(table, bins, w, rounds=4, max_depth=2, rate=0.3, refresh=2, one_vs_rest=True)
    assert 4 <= len(passes) <= 8
    weighted = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(train.withColumns(
        {"weight": F.array(*[F.lit(v) for v in w])[F.col("label").cast("int")], "label": F.col("label").cast("double")}))
    gbt = GBTClassifier(maxIter=4, maxDepth=2, stepSize=0.3, weightCol="weight", maxBins=256)
    out = weighted
    for i, m in enumerate(OneVsRest(classifier=gbt, weightCol="weight").fit(weighted).models):
        out = m.copy().setProbabilityCol(f"q{i}").setRawPredictionCol(f"r{i}").setPredictionCol(f"c{i}").transform(out) \
            .withColumn(f"q{i}", vector_to_array(f"q{i}")[1])
    want = {r.operation_id: np.array([r.q0, r.q1, r.q2]) / (r.q0 + r.q1 + r.q2) for r in out.collect()}
    got = model.probabilities(train).collect()
    assert len(got) == 600
    for r in got:
        assert [r[c] for c in ht.PROBABILITIES] == pytest.approx(want[r.operation_id].tolist(), abs=1e-7)


def test_rows_are_stored_once_whatever_the_number_of_trees(spark, monkeypatch):
    """Copies for trees and folds are unfolded by the tasks; a model is a row a subtree, not one a node."""
    data = rows(700, 5)
    stored, plain = [], ht.written_once

    def kept(df, name):
        out = plain(df, name)
        if name == "tree_blocks":
            stored.append(out.agg(F.sum("n")).first()[0])
        return out

    monkeypatch.setattr(ht, "written_once", kept)
    model = ht.fit_forest(frame(spark, data), COLUMNS, trees=6, local_rows=200, max_bins=16)
    folded = frame(spark, data).withColumn("fold", F.pmod(F.xxhash64("operation_id"), F.lit(3)).cast("int"))
    points, cut = ht.search_trees(folded, COLUMNS, {"max_depth": [None, 2], "min_samples_leaf": [1, 4]}, 3, local_rows=150)
    assert stored == [700, 700]
    monkeypatch.undo()
    assert cut == pytest.approx(ht.search_trees(folded, COLUMNS, {"max_depth": [None, 2], "min_samples_leaf": [1, 4]}, 3)[1])
    rows_of, nodes = model.table.count(), model.nodes.count()
    assert rows_of < nodes / 2 and model.table.agg(F.sum("n")).first()[0] == nodes


def test_large_binary_values_are_read_in_small_groups(spark):
    """Spark decodes a row group of up to 4,096 rows at once, whatever the length of its values."""
    import pyarrow.parquet as pq
    from fraudlens.session import written_once
    df = spark.range(0, 600, 1, 1).select(F.expr("cast(repeat(sha2(string(id), 512), 800) as binary)").alias("data"))  # 60 MB
    out = written_once(df, "blocks")
    assert out.selectExpr("sum(length(data))").first()[0] == 600 * 128 * 800
    groups = [m.row_group(i) for f in out.inputFiles() for m in [pq.read_metadata(f.replace("file:", "").replace("//", "", 1))]
              for i in range(m.num_row_groups)]
    assert max(g.num_rows for g in groups) <= 256 and max(g.total_byte_size for g in groups) < 32 << 20


def test_one_task_boosts_like_the_passes(spark, monkeypatch):
    """Few rows: the same trees, to the last bit, without a job for every level of every round."""
    train = frame(spark, rows(1200, 31))
    table, bins = ht.binned_training(train, COLUMNS, max_bins=40)
    w = ht.class_weights(train)
    plain = ht.fit_boosting
    for one_vs_rest in (False, True):
        want = plain(table, bins, w, 7, 3, 0.2, refresh=3, one_vs_rest=one_vs_rest)
        with monkeypatch.context() as m:
            m.setattr(ht, "fit_boosting", lambda *a, **k: pytest.fail("a job for every level"))
            got = ht.boosted(table, bins, w, 7, 3, 0.2, one_vs_rest)
        assert got == want and any(len(t["feature"]) > 9 for ts in got.trees for t in ts)


def test_fits_of_a_boosting_grid_run_side_by_side(spark, monkeypatch):
    folded = frame(spark, rows(700, 33)).withColumn("fold", F.pmod(F.xxhash64("operation_id"), F.lit(3)).cast("int"))
    grid = {"n_estimators": [2, 5], "max_depth": [1, 3], "learning_rate": [0.1, 0.4]}
    with monkeypatch.context() as m:
        m.setattr(ht, "fit_boosting", lambda *a, **k: pytest.fail("a job for every level"))
        points, recalls = ht.search_boosting(folded, COLUMNS, grid, 3)
    monkeypatch.setattr(ht, "TASK_ROWS", 0)
    assert (points, recalls) == ht.search_boosting(folded, COLUMNS, grid, 3) and len(set(recalls)) > 3


def test_joint_codes_tell_every_bin():
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, k, 500) for k in (90, 7, 2, 30, 2, 1)]).astype(np.uint8)
    groups = ht.joint_codes(x, 64)
    assert sorted(f for g in groups for f in g[0]) == list(range(6)) and len(groups) < 6
    for features, code, bins in groups:
        assert len(features) == 1 or bins.shape[1] <= 64
        assert all((bins[i][code] == x[f]).all() for i, f in enumerate(features))


def test_keys_are_dealt_one_to_a_partition(spark):
    keys = ht._side_by_side(spark, 9)
    found = spark.createDataFrame([(k,) for k in keys], "k int").repartition(9, "k").select("k", F.spark_partition_id().alias("p"))
    assert {r.p: r.k for r in found.collect()} == dict(enumerate(keys))


def test_a_forests_grid_is_scored_where_its_trees_grow(spark, monkeypatch):
    """No tree reaches the driver or a table, no copies of rows are shuffled; the recalls are those of the stored trees."""
    folded = frame(spark, rows(700, 35)).withColumn("fold", F.pmod(F.xxhash64("operation_id"), F.lit(3)).cast("int"))
    grid = {"n_estimators": [3, 8], "max_depth": [None, 2, 5], "min_samples_split": [2, 30], "min_samples_leaf": [1, 4]}
    with monkeypatch.context() as m:
        m.setattr(ht, "grow", lambda *a, **k: pytest.fail("stored trees"))
        m.setattr(ht, "TASK_TREES", 2)
        points, recalls = ht.search_trees(folded, COLUMNS, grid, 3, forest=True)
    monkeypatch.setattr(ht, "TASK_ROWS", 0)
    assert (points, pytest.approx(recalls)) == ht.search_trees(folded, COLUMNS, grid, 3, forest=True)
    assert len(points) == 24 and len(set(recalls)) > 6


def test_ends_of_cuts_are_those_of_walks():
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 40, (600, 3)).astype(np.uint8), rng.integers(0, 3, 600)
    tree = ht.Tree(*ht.grown_subtree(x, y, np.ones(600, int), 40, np.ones(3), ht.TreeParams(), 0, ""))
    cuts = [(None, 2), (3, 2), (None, 25), (6, 60), (0, 2)]
    want = tree.leaves(x, cuts)
    last = tree.leaves(x, [(None, 0)])[0]
    assert (tree.ends(cuts)[:, last] == want).all() and len(set(want[1].tolist())) > 4
