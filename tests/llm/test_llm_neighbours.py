import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fraudlens.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def single(rows):
    return [(i, v if v is None else [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows]


def recall(rows, got, k=neighbours.K, every=neighbours.EVERY):
    """Share of the true neighbours' places filled; checks ranks, scores and order on the way."""
    want = neighbours.brute_force(single(rows), k, every)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    scores = {(q, i): s for q, lists in neighbours.brute_force(single(rows), len(rows), every).items()
              for found in lists for i, s in found}
    hit = total = 0
    for q, lists in want.items():
        true = Counter(i for found in lists for i, _ in found)
        mine = Counter(r.vec_id for r in by.get(q, []))
        hit += sum((true & mine).values())
        total += sum(true.values())
        assert Counter(r.rank for r in by.get(q, [])) == Counter(
            {j + 1: len(lists) for j in range(len(by.get(q, [])) // len(lists))})
        for r in by.get(q, []):
            assert r.score == scores[q, r.vec_id]
        rows_q = sorted(by.get(q, []), key=lambda r: r.rank)
        assert [-r.score for r in rows_q] == sorted(-r.score for r in rows_q)
    assert set(by) <= set(want)
    return hit / max(1, total)


def test_awkward_rows_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) * (1 + i % 3) for _ in range(6)]) for i in range(300)]
    hot = [0.5, -1.0, 0.25, 2.0, 0.0, 1.0]
    rows += [(1000 + i, hot) for i in range(150)]  # copies, queries among them
    rows += [(20, rows[20][1])] * 2 + [(None, rows[3][1])] + [(2 ** 63 - 8 - i, rows[i][1]) for i in range(40)]
    rows += [(60, None), (80, [None] + [1.0] * 5), (100, [math.nan] * 6), (120, [math.inf] * 6), (140, [0.0] * 6),
             (160, []), (180, [-0.0] * 6), (200, [1.0, 2.0]), (201, [2.0, 1.0]), (220, [1.0, 2.0, 3.0]), (None, None)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(4)
    for name in ("v", "key", "id", "q", "score"):
        df = df.withColumn(name, F.lit(name))
    got = neighbours.search(df, recall=1.0).collect()
    want = neighbours.brute_force(single(rows))
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == {q for q, lists in want.items() if lists[0]}
    for q, lists in want.items():
        assert sorted(by.get(q, []), key=repr) == sorted(
            ((j + 1, i, s) for found in lists for j, (i, s) in enumerate(found)), key=repr)


def test_tiles_blocks_and_splits_lose_nothing(spark):
    rng = random.Random(7)
    centre = [rng.gauss(0, 1) for _ in range(8)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(500)]
    rows += [(500 + i, [c + rng.gauss(0, 0.01) for c in centre]) for i in range(400)]  # one hot bucket
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = neighbours.search(df, recall=1.0, cell_rows=8, tile_rows=64, block_queries=5, max_cells=200).collect()
    assert recall(rows, got) >= 0.99


def test_recall_of_the_default_search(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)]) for i in range(3000)]
    rows += [(3000 + i, [c + rng.gauss(0, 0.05) for c in rows[i][1]]) for i in range(500)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    assert recall(rows, neighbours.report(df).collect()) >= 0.9


def test_empty_tables(spark):
    assert neighbours.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert neighbours.report(spark.createDataFrame([(20, [1.0], 0)], SCHEMA)).collect() == []
    assert neighbours.report(spark.createDataFrame([(1, [1.0], 0), (2, [2.0], 0)], SCHEMA)).collect() == []
    two = neighbours.report(spark.createDataFrame([(20, [1.0], 0), (2, [2.0], 0)], SCHEMA)).collect()
    assert [tuple(r) for r in two] == [(20, 1, 2, 2.0)]


def test_probes_are_in_falling_order_of_success():
    import pandas as pd
    cells = [(a, b) for a in range(-3, 3) for b in range(-3, 3)]
    d = neighbours.Directory(pd.DataFrame([(0, 2, c, 1) for c in cells], columns=["t", "d", "cell", "n"]), 2, 10)
    order, before = d.probes(0, 2, np.array([[0.2, 0.9]]), 0.5)
    assert tuple(d.cells[0, 2][order[0, 0]]) == (0, 0) and tuple(d.cells[0, 2][order[0, 1]]) == (0, 1)
    chance = d.chances(0, 2, np.array([[0.2, 0.9]]), 0.5)[0][order[0]]
    assert (np.diff(chance) <= 0).all() and abs(chance.sum() - 1) < 0.01 and before[0, 0] == 0
