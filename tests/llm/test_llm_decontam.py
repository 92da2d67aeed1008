import random
from collections import Counter

import pytest
from llm_data import awkward_rows, clashing, docs, sentence

from fraudlens.llm import decontam as D

ITEMS = "item_id string, text string"


def items(rng):
    base = [r[1] for r in awkward_rows() if r[0] == 100][0]
    return [("a", sentence(rng, 40)), ("b", base[:300]), ("c", "word"), ("c", "word"), ("d", None), ("e", " ,. "),
            (None, sentence(rng, 14)), ("g", "the same id another"), ("h", "is, a? TEXT; without"), ("i", base[200:520])]


def documents(rng, bench):
    rows = awkward_rows()
    a = bench[0][1]
    rows += [(600, sentence(rng, 100) + " " + "".join(c.upper() if c.isascii() else c for c in a).replace(" ", ", "), None, None, None),
             (601, sentence(rng, 400) + " " + " ".join(a.split()[3:16]) + " " + sentence(rng, 400), None, None, None),
             (602, " ".join(a.split()[3:15]), None, None, None),  # twelve words: no window
             (603, " ".join([a] * 30), None, None, None)]
    return rows


def rows_of(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect())


@pytest.mark.parametrize("step_bytes", [D.STEP_BYTES, 300])
def test_report_equals_brute_force(spark, step_bytes, monkeypatch):
    rng = random.Random(6)
    bench = items(rng)
    rows = [r for r in documents(rng, bench) if r[0] != 303]
    want = Counter((r[0], *D.brute_force(r[1], [(i or "", t) for i, t in bench])) for r in rows)
    assert sum(k[-1] for k in want) > 3
    if step_bytes != D.STEP_BYTES:
        real = D.search_benchmark
        monkeypatch.setattr(D, "search_benchmark", lambda *a, **k: real(*a, step_bytes=step_bytes, **k))
    assert rows_of(D.report(docs(spark, rows), spark.createDataFrame(bench, ITEMS))) == want


def test_decontaminate_keeps_clean_documents_and_their_columns(spark):
    rng = random.Random(6)
    bench = items(rng)
    rows = documents(rng, bench)
    df = clashing(docs(spark, rows))
    out = D.decontaminate(df, spark.createDataFrame(bench, ITEMS))
    assert out.schema == df.schema
    bad = {r.doc_id for r in D.report(df, spark.createDataFrame(bench, ITEMS)).collect() if r.contaminated}
    left = {r.doc_id for r in out.collect()}
    assert 600 in bad and 603 in bad and not bad & {601, 602, 300, 301} and {601, 602, 300, 301} <= left
    assert not left & (bad - {7})


def test_tasks_hold_one_step_of_the_benchmark(spark):
    rng = random.Random(6)
    bench = items(rng)
    df, items_df = clashing(docs(spark, documents(rng, bench))), spark.createDataFrame(bench, ITEMS)
    many = D.search_benchmark(df, items_df, step_bytes=300, result="result")
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and len(list(D.steps_of(items_df, "item_id", "text", 300))) > 1
    assert many.columns == [*df.columns, "result"]
    assert Counter(map(str, many.collect())) == Counter(map(str, D.search_benchmark(df, items_df, result="result").collect()))


def test_empty_sides(spark):
    none = spark.createDataFrame([], ITEMS)
    got = D.report(docs(spark), none).collect()
    assert len(got) == len(awkward_rows()) and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert D.report(docs(spark, []), spark.createDataFrame([("a", "b c")], ITEMS)).collect() == []


def test_shifts_skip_and_find_all():
    rng = random.Random(0)
    for m in (1, 2, 3, 5):
        for _ in range(300):
            patterns = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(m)): {"x"} for _ in range(rng.randint(1, 4))}
            words = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 40))]
            table = D.WuManber([("x", list(p)) for p in patterns], m)
            found = sorted(s for s, _ in table.search(words))
            assert all(table.items_of(k) == {"x"} for _, k in table.search(words))
            assert found == [i for i in range(len(words) - m + 1) if tuple(words[i:i + m]) in patterns]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(D, "hash", lambda x: 5, raising=False)  # every block and window meets every other
    rng = random.Random(1)
    bench = [(f"i{k}", " ".join(rng.choice("abcd") for _ in range(rng.choice([0, 2, 13, 20, 30])))) for k in range(25)]
    text = " ".join(rng.choice("abcd") for _ in range(200)) + " " + " ".join(t for _, t in bench)
    n, spans, found = D.find(text, D.build_tables(bench))
    assert (n, sum(spans[1::2]) - sum(spans[::2]), len(found)) == D.brute_force(text, bench)[:3]


@pytest.mark.parametrize("size,window", [(40, 13), (100, 13), (60, 3), (10, 1), (5, 2)])
def test_pieces_of_a_long_item_hold_each_of_its_windows(size, window):
    rng = random.Random(size)
    for n in (0, 1, window - 1, window, window + 1, 60, 300):
        text = sentence(rng, n) + " É中 W"
        words, parts = D.words_of(text), [D.words_of(p) for p in D.pieces(text, size, window)]
        m = min(window, len(words))
        all_ = [tuple(words[i:i + m]) for i in range(len(words) - m + 1)]
        assert [tuple(p[i:i + m]) for p in parts for i in range(len(p) - m + 1)] == all_  # each once, in order
        assert all(len(p) >= m for p in parts) and (len(parts) > 1 or n < 60)
    assert list(D.pieces(None, 5)) == [None] and list(D.pieces("", 0)) == [""]


def test_windows_of_an_over_long_item_are_all_found(spark):
    rng = random.Random(9)
    bench = [("long", sentence(rng, 2_000)), ("b", sentence(rng, 20))]
    words = bench[0][1].split()
    rows = [(i, " ".join(words[at:at + 13]), None, None, None) for i, at in enumerate(range(0, 1_988, 7))]
    rows += [(1000, " ".join(words[:700] + ["x"] + words[1_100:]), None, None, None)]
    df, items_df = docs(spark, rows), spark.createDataFrame(bench, ITEMS)
    assert max(len(s) for s in D.steps_of(items_df, "item_id", "text", 900)) <= 2
    got = {r.doc_id: r.found for r in D.search_benchmark(df, items_df, step_bytes=900).collect()}
    for i, r in enumerate(rows[:-1]):
        assert got[i]["items"] == ["long"] and got[i]["hits"] == [0, got[i]["n_words"]], i
    n, hits, items_ = D.find(rows[-1][1], D.build_tables(bench))
    assert (got[1000]["n_words"], list(got[1000]["hits"]), set(got[1000]["items"])) == (n, hits, items_)


def test_tables_take_some_tens_of_bytes_a_word():
    import tracemalloc
    rng = random.Random(2)
    bench = [(str(i), sentence(rng, 500)) for i in range(200)]
    tracemalloc.start()
    try:
        tables = D.build_tables(bench)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert len(tables) == 1 and kept < 100 * 100_000 and peak < 300 * 100_000


def test_words():
    assert D.words_of("Don't STOP-é9\x7f_Ä ÀB") == ["don", "t", "stop", "é9", "Ä", "Àb"] or \
        [w.decode() for w in D.words_of("Don't STOP-é9\x7f_Ä ÀB")] == ["don", "t", "stop", "é9", "Ä", "Àb"]
