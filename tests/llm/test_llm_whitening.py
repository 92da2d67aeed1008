import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraudlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_force(rows):
    """(vec_id, x) rows, n, deviation by row, eigenvalues falling, components, trace."""
    good = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), np.array(fit, object).sum(axis=0)
    y = np.array(fit, float) - np.array(s / n, float)
    e, v = np.linalg.eigh(y.T @ y / n)
    dev = [sum((n * a - b) ** 2 for a, b in zip(x, s)) for _, x in good]
    return good, n, s, dev, e[::-1], v[:, ::-1].T


def check(rows, got, count):
    good, n, s, dev, e, v = brute_force(rows)
    assert len(got) == len(good) * count
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    x = {(i, d): np.array(x, float) - np.array(s / n, float) for (i, x), d in zip(good, dev)}
    assert set(by) == set(x)
    signs = {}
    for key, parts in by.items():
        assert sorted(parts) == list(range(1, count + 1))
        for c, rs in parts.items():
            want = x[key] @ v[c - 1] / math.sqrt(e[c - 1])
            signs.setdefault(c, 1 if abs(want - rs[0].whitened) < abs(want + rs[0].whitened) else -1)
            for r in rs:
                assert r.whitened == pytest.approx(signs[c] * want, abs=1e-8)
                assert r.n == n and r.explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
                assert r.identity_error < 1e-9


def vectors(rng, n, d):
    spread = [3.0 / (i + 1) for i in range(d)]
    return [[rng.gauss(0.1, s) for s in spread] for _ in range(n)]


def test_whitening_equals_brute_force(spark):
    rng = random.Random(4)
    rows = list(enumerate(vectors(rng, 300, 7)))
    rows += [(2 ** 63 - 1 - i, rows[i][1]) for i in range(3)] + [(None, rows[5][1])] + [(500, rows[9][1])] * 120
    bad = [(600, None), (601, [None] + [0.0] * 6), (602, [math.nan] * 7), (603, [math.inf] * 7), (604, [-math.inf] * 7),
           (605, [0.5] * 3), (None, None), (606, [1e30] * 7), (607, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + bad], SCHEMA).repartition(5)
    for name in ("x", "n", "component", "i", "d"):
        df = df.withColumn(name, F.lit(name))
    check(rows, whitening.report(df).collect(), 4)


def test_short_tables(spark):
    def run(rows):
        return whitening.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert run([]) == [] and run([(1, None, 0)]) == [] and run([(1, [], 0)]) == []
    assert run([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]) == []
    two = run([(1, [1.0, 2.0], 0), (2, [2.0, 4.0], 0), (3, [1.0, 2.0], 0)])  # one direction only
    assert [(r.component, r.n, r.explained) for r in two] == [(1, 2, 1.0)] * 3
    assert sorted(abs(r.whitened) for r in two) == pytest.approx([1.0] * 3)
    # equal eigenvalues: an orthonormal basis, whitened to the identity
    square = run([(i, [float(a), float(b)], 0) for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])])
    assert {r.component for r in square} == {1, 2} and all(r.identity_error < 1e-12 for r in square)
    assert all(r.explained == 0.5 for r in square)


def test_large_entries_are_exact(spark):
    rows = [(i, [1e12 + i, -1e12 * i, 3.0]) for i in range(6)]
    got = whitening.report(spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, l int"))
    x = [[math.floor(256 * c) for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x)]
    want = [sum((6 * a - b) ** 2 for a, b in zip(v, s)) for v in x]
    for r in got.filter("component = 1").collect():
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 2 ** 63 else None)


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(3)
    for d in (1, 2, 5, 9):
        a = rng.integers(-50, 50, (d, d)).astype(object)
        c = a @ a.T
        if d == 9:  # a zero column below the diagonal while reducing
            c[0, 1:] = c[1:, 0] = 0
        poly = whitening.characteristic_polynomial(spark, c)
        # Faddeev-LeVerrier in integers
        m, want = np.zeros((d, d), object), [1]
        for k in range(1, d + 1):
            m = c @ m + want[-1] * np.eye(d, dtype=int).astype(object)
            want.append(-int(np.trace(c @ m)) // k)
        assert poly == want[::-1]
        e = np.linalg.eigvalsh(c.astype(float))[::-1]
        roots = whitening.largest_roots(poly, int(np.trace(c)), 4)
        assert [r / 2 ** whitening.SCALE_BITS for r in roots] == pytest.approx(e[:len(roots)].tolist(), rel=1e-9, abs=1e-6)
        v = whitening.null_vectors(c, roots)
        for r, row in zip(roots, v):
            assert np.abs(c.astype(float) @ row - r / 2 ** whitening.SCALE_BITS * row).max() < 1e-8 * max(1.0, e[0])
        assert np.abs(v @ v.T - np.eye(len(v))).max() < 1e-14


def test_intervals_count_multiple_roots():
    poly = [-8, 12, -6, 1]  # (t - 2)^3
    assert [whitening.roots_beyond(poly, a) for a in (0, 1, 2, 3)] == [3, 3, 0, 0]
    assert whitening.largest_roots(poly, 6, 4, 10) == [2 << 10] * 3
