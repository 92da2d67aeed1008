from collections import defaultdict

import pytest
from llm_data import awkward_rows, clashing, docs

from fraudlens.llm import quality


def brute_repeated(words):
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(5)})


def test_metrics():
    assert quality.metrics_of(None) == quality.metrics_of("") == (0,) * 6
    text = "a b c d e f\n\n \na b c d e f\n#x $%\na b c d e f"
    n, chars, symbols, lines, dup, repeated = quality.metrics_of(text)
    assert (n, symbols, lines, dup) == (20, 3, 4, 2)
    assert repeated == brute_repeated(text.split()) == 18
    assert quality.repeated_words(["x"] * 7) == 7
    assert quality.repeated_words(list("abcde")) == 0


def test_report_over_awkward_rows(spark):
    rows = awkward_rows()
    got = quality.report(docs(spark)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for doc_id, text, *_ in rows:
        want[doc_id].append(quality.metrics_of(text))
    for r in got:
        m = (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words)
        assert m in want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (not r.base_failed and not r.host_rejected)
        assert r.soft_failed or not r.host_rejected


def host_rows(n_good, n_bad, source, first, marks="*"):
    """Good documents, then some with a symbol or more after each word: one is 1.5 times past the rule."""
    good = " ".join(f"word{i}" for i in range(30))
    bad = " ".join(f"word{i}{marks}" for i in range(30))
    return [(first + i, good if i < n_good else bad, "en", source, 1) for i in range(n_good + n_bad)]


def brute_kept(rows):
    """Verdicts by the docstring, one row at a time."""
    size, failed, judged = defaultdict(int), defaultdict(int), []
    for _, text, _, source, _ in rows:
        n, chars, symbols, lines, dup, repeated = quality.metrics_of(text)
        base = n < 10 or 100 * repeated > 20 * n
        past = 0.0 if base else max(symbols / (0.1 * chars), dup / (0.3 * lines), 2 * n / chars, chars / (20 * n))
        judged.append((base, past, source))
        size[source] += 1
        failed[source] += base or past > 1
    total, bad = sum(size.values()), sum(failed.values())
    mean = bad / total
    between = sum(failed[h] ** 2 / size[h] for h in size) / total - mean ** 2 - mean * (1 - mean) * len(size) / total
    weight = min(1000.0, max(1.0, mean * (1 - mean) / between - 1)) if between > 0 else 1000.0
    rate = {h: (failed[h] + mean * weight) / (size[h] + weight) for h in size}
    return [not base and past <= 1 + (1 - rate[source]) for base, past, source in judged]


def many_hosts():
    rows = host_rows(20, 80, "bad", 0) + host_rows(2000, 20, "good", 1000) + host_rows(0, 1, "tiny", 5000) \
        + host_rows(1500, 10, None, 6000) + host_rows(300, 6, "junk", 8000, "***")
    for h in range(20):
        rows += host_rows(100, 2, f"h{h}", 10_000 + 1000 * h)
    return rows


def test_a_host_with_many_failures_tolerates_less(spark):
    got = {r.doc_id: r for r in quality.report(docs(spark, many_hosts())).collect()}
    assert all(got[i].kept for i in range(20)) and not any(got[i].kept for i in range(20, 100))
    assert all(got[i].kept for i in range(1000, 3020))
    assert all(got[i].kept for i in range(6000, 7510))
    assert all(got[i].soft_failed and not got[i].base_failed for i in range(3000, 3020))
    # far past a rule: rejected in a host that is good otherwise
    assert all(got[i].kept for i in range(8000, 8300)) and not any(got[i].kept for i in range(8300, 8306))


def test_verdicts_equal_a_brute_force(spark):
    rows = many_hosts()
    got = {r.doc_id: r.kept for r in quality.report(docs(spark, rows)).collect()}
    assert got == {r[0]: k for r, k in zip(rows, brute_kept(rows))}
    assert {r.doc_id for r in quality.keep_good(docs(spark, rows)).collect()} == {i for i, k in got.items() if k}
    strict = {r.doc_id for r in quality.keep_good(docs(spark, rows), headroom=0.0).collect()}
    assert strict < {i for i, k in got.items() if k}


def test_prior_shrinks_small_hosts_towards_the_mean(spark):
    hosts = spark.createDataFrame([(1000, 20)] * 10 + [(1000, 400)] + [(1, 1)], "n long, failed long")
    alpha, beta = quality.beta_prior(hosts)
    mean = alpha / (alpha + beta)
    assert mean == pytest.approx((10 * 20 + 400 + 1) / (11 * 1000 + 1))
    assert (1 + alpha) / (1 + alpha + beta) < 0.5 and (400 + alpha) / (1000 + alpha + beta) > 0.3
    assert quality.beta_prior(hosts.limit(0)) == (0.5, 0.5)


def test_keep_good_returns_the_documents_own_columns(spark):
    df = clashing(docs(spark))
    out = quality.keep_good(df)
    assert out.columns == df.columns and out.schema == df.schema
    ids = {r.doc_id for r in quality.report(docs(spark)).filter("kept").collect()}
    assert {r.doc_id for r in out.collect()} == ids
    assert quality.keep_good(docs(spark, [])).collect() == []


def test_texts_are_measured_once_a_pass(spark):
    plan = quality.keep_good(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
