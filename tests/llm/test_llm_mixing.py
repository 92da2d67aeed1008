import re
from collections import Counter, defaultdict

import pytest
from llm_data import awkward_rows, clashing, docs

from fraudlens.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected_targets(size_of, weights=(5, 2, 1), share=1.5, epochs=2):
    """Shares by weight; what is above a limit is shared again until nothing is."""
    names = sorted((s for s in size_of if s is not None), key=lambda s: s.encode()) + [None] * (None in size_of)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(size_of.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(epochs * size_of[s] for s in full)
        target = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if target[s] > epochs * size_of[s]}
        if not over:
            return target | {s: float(epochs * size_of[s]) for s in full}
        full |= over


def test_report_targets_and_taken(spark):
    rows = awkward_rows()
    got = mixing.report(docs(spark).select("doc_id", "text", "source")).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size_of = defaultdict(int)
    for _, text, _, source, _ in rows:
        size_of[source] += len(WORD.findall(text or ""))
    assert all(r.taken <= 2 * r["size"] for r in got)
    targets = expected_targets(size_of)
    by_target = defaultdict(int)
    for r in got:
        by_target[r.source_size, round(r.target, 6)] += r.taken
    want = defaultdict(int)
    for s, t in targets.items():
        want[size_of[s], round(t, 6)] += round(t)
    assert {k: v for k, v in by_target.items()} == pytest.approx(dict(want), abs=1)


def test_reruns_agree_whatever_the_partitions(spark):
    a = sorted(map(tuple, mixing.report(docs(spark).repartition(2)).collect()), key=str)
    b = sorted(map(tuple, mixing.report(docs(spark).repartition(7)).collect()), key=str)
    assert a == b


def test_slots_are_permutations_and_shards_are_full(spark):
    rows = mixing.sizes(docs(spark), "text", "source", "doc_id")
    held, slots = mixing.mix(rows, block=16, shard_blocks=64)
    got = slots.collect()
    uses = defaultdict(list)
    for r in got:
        uses[r["rank"], r.epoch].append(r.block)
    for (rank, epoch), blocks in uses.items():
        assert len(blocks) == len(set(blocks)), (rank, epoch)
    shards = Counter(r.shard for r in got)
    assert sum(shards.values()) == len(got) and max(shards) <= len(got) // 64 + 1
    assert max(shards.values()) <= 2 * 64
    # blocks hold the words of their source once, in full but for the last
    held_words = Counter()
    for r in held.filter("block IS NOT NULL").collect():
        assert 0 <= r.low < r.high <= 16
        held_words[r["rank"], r.block] += r.high - r.low
    last = {rank: max(b for k, b in held_words if k == rank) for rank, _ in held_words}
    assert all(n == 16 for (rank, b), n in held_words.items() if b != last[rank])


def test_a_row_that_most_rows_equal_fills_no_bucket(spark):
    from pyspark.sql import functions as F
    n = 4000
    rows = [(i, f"row {i} has some words of its own", "en", "hot", 1) for i in range(n // 4)]
    rows += [(9, "the same seven words over and over", "en", "hot", 1)] * (n - len(rows))
    df = docs(spark, rows).repartition(8)
    entries = mixing.sizes(df.select("doc_id", "text", "source"), "text", "source", "doc_id")
    assert mixing.n_rows(entries) == n and entries.count() <= n // 4 + 8
    largest = mixing.bucketed(entries, n).groupBy("source", "bucket").count().agg(F.max("count")).first()[0]
    assert largest < 4 * n ** 0.5
    got = Counter(map(tuple, mixing.report(df).collect()))
    assert sum(got.values()) == n and sum(k[4] * v for k, v in got.items()) == round(1.5 * (8 * n // 4 + 7 * 3 * n // 4))
    assert got == Counter(map(tuple, mixing.report(df.coalesce(2)).collect()))
    out = Counter(r.doc_id for r in mixing.mixed_documents(df, block=16, shard_blocks=64).select("doc_id").collect())
    assert out[9] >= 3 * n // 4


def test_multinomial_draw_follows_the_weights(spark):
    q = spark.createDataFrame([("a", 0, 1, 500, 6000, 64), ("b", 1, 2, 500, 3000, 64), ("c", 2, 3, 500, 1000, 64)],
                              "source string, rank int, key long, blocks long, slots long, last_words long")
    n = {r["rank"]: r.n for r in mixing.drawn(q, 10_000, 500).groupBy("rank").agg({"n": "sum"})
         .withColumnRenamed("sum(n)", "n").collect()}
    assert sum(n.values()) == 10_000
    assert abs(n[0] - 6000) < 250 and abs(n[1] - 3000) < 250 and abs(n[2] - 1000) < 150
    every = mixing.slots(q, 10_000, 64, 500).groupBy("rank").count().collect()
    assert {r["rank"]: r["count"] for r in every} == {0: 6000, 1: 3000, 2: 1000}


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_shuffle_is_a_permutation_with_its_inverse(spark, n):
    from pyspark.sql import functions as F
    k, size, key = F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")
    df = spark.range(n).select(k, mixing.shuffled(k, size, key).alias("p"))
    got = {r.id: r.p for r in df.collect()}
    assert sorted(got.values()) == list(range(n))
    back = df.select("id", mixing.shuffled(F.col("p"), size, key, inverse=True).alias("q")).collect()
    assert all(r.id == r.q for r in back)
    if n == 1000:
        assert sum(p == i for i, p in got.items()) < 20


def test_mixed_documents_hold_the_words_taken(spark):
    rows = awkward_rows()
    out = mixing.mixed_documents(clashing(docs(spark)))
    assert out.columns == clashing(docs(spark)).columns
    got = out.collect()
    taken = {}
    for r in mixing.report(docs(spark)).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = Counter()
    for r in got:
        assert r.text and r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    # the same rows, the same mix but for the row hash, which other columns take part in
    assert sum(words.values()) == sum(taken.values())
    texts = defaultdict(list)
    for doc_id, text, *_ in rows:
        texts[doc_id].append("".join(re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text or "")))
    assert all(any(len(r.text) <= len(t) for t in texts[r.doc_id]) for r in got)
    short = [r for r in got if r.doc_id == 305]
    assert all(r.text == "word" for r in short)


def test_empty_table(spark):
    assert mixing.report(docs(spark, [])).collect() == []
    assert mixing.mixed_documents(docs(spark, [])).collect() == []
    blank = [(1, None, None, "a", None), (2, " ", None, None, None)]
    assert [(r.doc_id, r["size"], r.target, r.taken) for r in mixing.report(docs(spark, blank)).orderBy("doc_id").collect()] \
        == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_main_path_runs_no_python(spark):
    plan = mixing.report(docs(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
