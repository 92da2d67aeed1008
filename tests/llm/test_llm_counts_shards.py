import zlib
from collections import Counter

import duckdb
import numpy as np
from llm_data import awkward_rows, clashing, docs
from tokenizers import Tokenizer

from fraudlens.llm import sharding, token_counts
from fraudlens.llm.tokenize import WordEncoder, tokenizer_path


def test_cached_encoding_equals_the_tokenizer():
    import random
    rng = random.Random(1)
    alphabet = "aAéßÉ'’.,<|>#1٣中́ͅ각ΣςİıK \x85\x1f \n\t\x00-_§½ǅ×÷ÿ"
    texts = ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(1500)]
    texts += ["don't <|endoftext|>x <|ENDOFTEXT|> I'll we'VE", "", "  ", "ﬁne ½ ǅ ß", *[r[1] for r in awkward_rows() if r[1]]]
    mine, own = WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for t in texts:
        assert mine.encode(t) == np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t[:80]


def test_histogram_and_suffix_sums(spark):
    own = Tokenizer.from_file(tokenizer_path())
    lengths = np.array([len(own.encode(r[1] or "", add_special_tokens=False).ids) for r in awkward_rows()])
    for block in (token_counts.BLOCK, 3):
        sums = token_counts.suffix_sums(token_counts.histogram(clashing(docs(spark))), block)
        got = {r.n_tokens: r for r in sums.collect()}
        assert {k: r.n_docs for k, r in got.items()} == Counter(lengths.tolist())
        for k, r in got.items():
            assert r.n_docs_longer == (lengths > k).sum() and r.n_tokens_longer == lengths[lengths > k].sum()
            assert r.truncated_total == np.minimum(lengths, k).sum()
            assert (r.total_docs, r.total_tokens) == (len(lengths), lengths.sum())
    for limit in (0, 1, 7, 100, 10**6):
        assert token_counts.truncated_total(sums, limit).first().tokens == np.minimum(lengths, limit).sum()
    for r in token_counts.quantiles(sums, [0.0, 0.1, 0.5, 0.9, 1.0]).collect():
        ordered = np.sort(lengths)
        assert r.n_tokens == ordered[max(0, int(np.ceil(r.q * len(ordered))) - 1)]
    assert token_counts.report(docs(spark, [])).collect() == []


def check_shards(rows, got, shards):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(
        (r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    for s, members in by.items():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert 0 <= s < shards
    # contiguous in the order of doc_id, nulls first
    last = None
    for s in sorted(by):
        ids = [-1 if r.doc_id is None else r.doc_id for r in sorted(by[s], key=lambda r: r.slot)]
        assert ids == sorted(ids) and (last is None or last <= ids[0])
        last = ids[-1]
    target, largest = sum(r["size"] for r in got) / shards, max(r["size"] for r in got)
    for s in range(shards):
        assert abs(sum(r["size"] for r in by.get(s, [])) - target) <= max(largest, 1)


def test_shards_are_contiguous_and_balanced(spark):
    rows = awkward_rows()
    check_shards(rows, sharding.report(docs(spark).repartition(5)).collect(), 16)
    rows = [(i, "x" * (i % 37), None, None, None) for i in range(3000)] + [(5, "hot", None, None, None)] * 1500
    got = sharding.assign(docs(spark, rows).repartition(6), 7).collect()
    check_shards(rows, got, 7)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 38
    assert sharding.report(docs(spark, [])).collect() == []
    assert [(r.shard, r.slot) for r in sharding.report(docs(spark, [(1, None, None, None, None)])).collect()] == [(8, 0)]


def test_shards_equal_their_sql(spark):
    rows = [r for r in awkward_rows() if r[0] != 303] + [(7, "the same id, another text", "xx", None, None)] * 3
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    for some in ([], rows):
        con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in some]) if some else None
        want = con.execute(f"SELECT doc_id, size, text_crc32, law, shard, slot, grown_shard FROM ({sharding.ORACLE})")
        got = sharding.report(clashing(docs(spark, some))).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
        assert Counter(want.fetchall()) == Counter(map(tuple, got.collect()))
