import random
from collections import Counter

import pytest
from llm_data import awkward_rows, clashing, docs

from fraudlens.llm import spelling


def as_table(rows):
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def noisy_rows(n=400, seed=5):
    """Texts of few words, misspelt in all ways, with copies of texts and mixed case."""
    rng = random.Random(seed)
    stems = ["".join(rng.choice("aeioulnrstbcdßéüçàÿñ") for _ in range(rng.randint(4, 13))) for _ in range(120)]

    def noisy(w):
        k, at = rng.random(), rng.randrange(len(w))
        if k < 0.06:
            return w[:at] + w[at + 1:]
        if k < 0.12:
            return w[:at] + rng.choice("aeéxst") + w[at:]
        if k < 0.18:
            return w[:at] + rng.choice("aeéxst") + w[at + 1:]
        if k < 0.22:
            return w[::-1] if k < 0.19 else w[:at] + w[at:][::-1]  # anagrams
        return w.upper() if k < 0.25 else w

    rows = [(i, " ".join(noisy(rng.choice(stems)) for _ in range(60)), "en", "s", 1) for i in range(n)]
    return rows + [(n + i, rows[0][1], "en", "s", 1) for i in range(30)]


@pytest.mark.parametrize("tile", [spelling.TILE_WORDS, 25])
def test_variants_equal_brute_force(spark, tile):
    rows = noisy_rows() + awkward_rows()
    got = as_table(spelling.variants(spelling.words(clashing(docs(spark, rows)).repartition(7)), tile).collect())
    want = spelling.brute_force([(r[0], r[1]) for r in rows])
    assert got == want
    assert any(v[0] for v in want.values()) and any(v[1] != v[0] and v[0] for v in want.values())


def test_report_and_empty_tables(spark):
    rows = noisy_rows(60, 9)
    got = spelling.report(docs(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert as_table(got.collect()) == spelling.brute_force([(r[0], r[1]) for r in rows])
    assert spelling.report(docs(spark, [])).collect() == []
    assert spelling.report(docs(spark, [(1, None, None, None, None), (None, "", None, None, None)])).collect() == []


def test_words_in_all_texts(spark, monkeypatch):
    """Counts of a task are passed on whenever they are many."""
    rows = awkward_rows()
    want = Counter()
    for i, text, *_ in rows:
        for m in spelling.RUN.finditer(spelling.lowered(text or "")):
            want[spelling.with_deletion(m.group(), i)] += 1
    for held in (spelling.HELD_WORDS, 3):
        monkeypatch.setattr(spelling, "HELD_WORDS", held)
        got = {r.word: r.n for r in spelling.words(docs(spark, rows), min_count=1).collect()}
        assert got == {w: n for w, n in want.items() if len(w) >= spelling.MIN_LETTERS}


def test_chains_of_forms_end_at_the_root():
    assert spelling.lowered("ÀÉ İAZ") == "ÀÉ İaz"
    rows = [(1, " ".join(["abcdef"] * 64 + ["abcdeg"] * 32 + ["abcdhg"] * 16 + ["abcihg"] * 8))]
    got = spelling.brute_force(rows, every=10**12)
    assert {w: v[:2] for w, v in got.items()} == {
        "abcdef": (None, "abcdef"), "abcdeg": ("abcdef", "abcdef"), "abcdhg": ("abcdeg", "abcdef"),
        "abcihg": ("abcdhg", "abcdef")}
