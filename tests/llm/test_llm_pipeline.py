import zlib
from collections import Counter

import duckdb
import numpy as np
from llm_data import awkward_rows, clashing, docs
from test_llm_quality import brute_kept
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from fraudlens.llm import decontam, simhash
from fraudlens.llm.tokenize import tokenizer_path

SF = "/root/testdata/sf0.001"


def test_stage_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontaminate", "mix", "token_files"]
    names = [k for k in entry.queries() if k.startswith("op") or k == "pipeline"]
    assert names[0] == "pipeline" and [int(k[2:].split("_")[0]) for k in names[1:]] == list(range(1, 14))


def test_filters_equal_brute_force(spark, tmp_path):
    """The first three stages against plain Python over whole documents."""
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source, n_chars FROM '{SF}/documents.parquet'").fetchall()
    bench = duckdb.sql(f"SELECT CAST(item_id AS VARCHAR), text FROM '{SF}/benchmark.parquet'").fetchall()
    df = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_rules(spark, df, SF)
    good = [r for r, k in zip(rows, brute_kept(rows)) if k]
    assert sorted(map(tuple, kept.collect())) == sorted(good)

    unique = corpus_pipeline.near_dedup(spark, kept, SF)
    fps = np.array([simhash.fingerprint(simhash.shingle_hashes(r[1])) for r in good], np.uint64)
    comp = np.arange(len(good))
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 2
    for _ in range(50):
        comp = np.array([comp[near[i]].min() for i in range(len(good))])
    least = {}
    for r, c in zip(good, comp.tolist()):
        least[c] = min(least.get(c, r), r)
    assert sorted(map(tuple, unique.collect())) == sorted(least.values())

    clean = corpus_pipeline.decontaminate(spark, unique, SF)
    want = [r for r in least.values() if not decontam.brute_force(r[1], bench)[-1]]
    assert sorted(map(tuple, clean.collect())) == sorted(want)
    assert clean.schema == df.schema


def test_mix_and_token_files(spark):
    df = docs(spark)
    mixed = corpus_pipeline.mix(spark, df, SF)
    assert mixed.columns == df.columns
    texts = mixed.collect()
    own = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in texts:
        ids = np.array([*own.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want[r.doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = corpus_pipeline.token_files(spark, mixed, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert sorted(r.start for r in got)[0] == 0


def test_every_stage_takes_awkward_and_empty_documents(spark, tmp_path):
    for i, rows in enumerate((awkward_rows(), [])):
        df = clashing(docs(spark, rows))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            if name != "token_files":
                assert out.columns == df.columns, name
                path = str(tmp_path / f"{i}-{name}")
                out.write.parquet(path)
                df = spark.read.parquet(path)
        assert bool(out.collect()) == bool(rows)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    assert got and {"doc_id", "start", "n_tokens", "ids_crc32"} == set(got[0].asDict())
