"""Order statistics, heavy hitters, ROC corners and roll-ups against brute force; nothing stays cached."""
import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from fraudlens.operators import eda, metrics as mt, rollup
from fraudlens.operators.selection import Counters, doubles, order_statistics, ordered_bits, top_values
from fraudlens.plans.registry import QUERIES
from fraudlens.sources.tables import transactions

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_bits_keep_the_order():
    x = np.array([-math.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf])
    u = ordered_bits(x)
    assert (np.diff(u.astype(object)) >= 0).all() and u[4] == u[5] and len(set(u.tolist())) == 10
    assert doubles(u).tolist() == (x + 0.0).tolist()


def test_order_statistics_equal_numpy(spark):
    rng = random.Random(2)
    rows = [("a", rng.gauss(0, 1) * 10 ** rng.randint(-9, 9)) for _ in range(3000)]
    rows += [("b", float(rng.randint(-3, 3))) for _ in range(2001)] + [("one", 7.5)] + [("hot", 2.0)] * 4000
    rows += [("a", None), ("a", math.nan), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double").repartition(6)
    got = order_statistics(df, "x", PROBS, "g")
    good = [(g, x) for g, x in rows if g is not None and x is not None and not math.isnan(x)]
    assert set(got) == {g for g, _ in good}
    for g, (n, q) in got.items():
        values = [x for k, x in good if k == g]
        assert n == len(values) and q == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12, abs=0)
    every = order_statistics(df, "x", [0.5])[""]
    assert every[1][0] == np.quantile([x for g, x in rows if x is not None and not math.isnan(x)], 0.5)
    assert order_statistics(df.limit(0), "x", PROBS) == {}


def test_counters_never_lose_more_than_they_say():
    rng = random.Random(3)
    true, c = Counter(), Counters(20)
    for _ in range(300):
        part = Counter(int(rng.paretovariate(0.7)) for _ in range(50))
        true += part
        c.add(list(map(str, part)), list(part.values()))
    assert len(c.counts) <= 20
    for v, n in true.items():
        assert n - c.lost <= c.counts.get(str(v), 0) <= n


@pytest.mark.parametrize("counters", [8, 1024])
def test_top_values_are_exact(spark, counters):
    rng = random.Random(5)
    rows = [(str(int(rng.paretovariate(0.5))), i, None if i % 7 == 0 else f"k{i % 3}") for i in range(5000)]
    rows += [("hot", 1, "k1")] * 2500
    df = spark.createDataFrame(rows, "a string, b long, c string").repartition(7)
    got = {}
    for r in top_values(df, ["a", "b", "c"], 12, counters).collect():
        got.setdefault(r.colonne, []).append((r.rang, r.valeur, r.nombre))
    for i, name in enumerate("abc"):
        counts = Counter(str(r[i]) for r in rows if r[i] is not None)
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:12]
        assert sorted(got[name]) == [(k + 1, v, n) for k, (v, n) in enumerate(want)]


def test_only_candidates_are_shuffled(spark):
    """Counters that prove themselves: neither aggregation sees the many rare values."""
    rows = [(f"h{i % 80}" if i % 2 else f"r{i}",) for i in range(20_000)]
    df = spark.createDataFrame(rows, "a string").coalesce(2)
    out = top_values(df, ["a"], 30, counters=2048)
    assert out.count() == 30
    assert {r.valeur[0] for r in out.collect()} == {"h"}


def test_roc_corners_bound_the_same_area(spark):
    rng = random.Random(4)
    rows = [(round(rng.random(), 2), rng.choice(["Fraude", "Normal"])) for _ in range(800)]
    rows += [(2 + i / 100, "Fraude") for i in range(60)] + [(-1 - i / 100, "Normal") for i in range(60)]
    df = spark.createDataFrame(rows, "p_fraud double, target string").repartition(5)
    pts = sorted((r.fpr, r.tpr) for r in mt.roc_corners(df).collect())
    every = sorted((r.fpr, r.tpr) for r in mt.roc_curve(df).collect())
    assert set(pts) <= set(every) and len(pts) < len(every) - 100 and pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)

    def area(p):
        return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(p, p[1:]))

    assert area(pts) == pytest.approx(area(every), abs=1e-5)
    assert area(every) == pytest.approx(mt.roc_auc(df).first()[0], abs=1e-5)


def test_rollup_answers_filters_within_its_errors(spark):
    tx = transactions(spark, "/root/testdata/sf0.01")
    table = rollup.build(tx).cache()
    try:
        assert table.count() <= 31 * 5 * 3
        for spec in (eda.FilterSpec(), eda.FilterSpec(date_from=dt.date(2024, 1, 10), tx_types=["view", "click"]),
                     eda.FilterSpec(targets=["Fraude"], date_to=dt.date(2024, 1, 3))):
            view = rollup.selected(table, spec)
            plain = eda.filtered_transactions(tx, spec) if spec != eda.FilterSpec() else tx
            got = rollup.kpis(view).first()
            want = plain.agg(F.count("*"), F.round(F.sum("amount"), 6), F.countDistinct("client_id")).first()
            assert (got.n_transactions, got.montant_total) == (want[0], pytest.approx(want[1]))
            assert abs(got.clients_estimes - want[2]) <= max(1, 0.05 * want[2])
            values = sorted(r.amount for r in plain.select("amount").where("amount is not null").collect())
            for r in rollup.quantiles(view, [0.25, 0.5, 0.75]).collect():
                rank = np.searchsorted(values, r.q) / len(values)
                assert abs(rank - r.p) < 0.02 + 1 / len(values)
        assert rollup.kpis(table.limit(0)).first().n_transactions == 0
        with pytest.raises(ValueError):
            rollup.selected(table, eda.FilterSpec(amount_min=1.0))
    finally:
        table.unpersist()


def test_nothing_stays_cached(spark):
    spark.catalog.clearCache()
    for name in ("value_frequency_top30", "amount_box_by_target", "describe_amount", "pr_curve", "standardized_features",
                 "location_type_volume", "roc_corners", "location_grouping", "stratified_split"):
        QUERIES[name](spark, SF0001).count()
        assert spark.sparkContext._jsc.sc().getPersistentRDDs().size() == 0, name
