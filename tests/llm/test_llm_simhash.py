import random

import numpy as np
import pytest
from llm_data import awkward_rows, clashing, docs, sentence

from fraudlens.llm import simhash


def brute_components(fps, bits):
    ids = list(range(len(fps)))
    a = np.array(fps, np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None]) <= bits
    comp = np.array(ids)
    while True:
        new = np.array([comp[near[i]].min() for i in ids])
        if (new == comp).all():
            return comp
        comp = new


def clustered(rng, centres, members, bits=3):
    out = []
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(members):
            x = c
            for _ in range(rng.randint(0, bits)):
                x ^= 1 << rng.randrange(64)
            out.append(x)
    return out


def same_partition(a, b):
    return len({*zip(a, b)}) == len(set(a)) == len(set(b))


@pytest.mark.parametrize("shard_size,members,visitors", [(8, 4096, 16384), (64, 16, 32), (10**6, 50, 70)])
def test_tree_links_every_near_pair(spark, shard_size, members, visitors):
    rng = random.Random(shard_size)
    fps = clustered(rng, 150, 4) + clustered(rng, 1, 400, 4) + [rng.getrandbits(64) for _ in range(800)] + [0, 1]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long").repartition(4)
    edges = simhash.links(df, 2, shard_size, members, visitors)
    found = edges.collect()
    assert all((int(r.a) ^ int(r.b)) & (2**64 - 1) for r in found)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in found)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    mine = [root.get(int(np.uint64(x).astype(np.int64)), int(np.uint64(x).astype(np.int64))) for x in fps]
    assert same_partition(mine, brute_components(fps, 2).tolist())


def test_tree_reaches_home_shards():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**64, 4000, np.uint64)
    tree = simhash.Tree(fps[:1000], 64)
    assert tree.shards > 30
    home = np.full(len(fps), -1)
    seen = set()
    for shard, at, is_home in tree.visits(fps, 2):
        assert (home[at[is_home]] == -1).all()
        home[at[is_home]] = shard
        seen.update((int(i), shard) for i in at)
    assert (home >= 0).all()
    for i in range(200):
        y = fps[i] ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
        (own,) = [s for s, at, h in tree.visits(np.array([y]), 2) if h.any()]
        of_y = {s for s, at, _ in tree.visits(np.array([y]), 2) if len(at)}
        assert (i, own) in seen or int(home[i]) in of_y
    assert len(seen) < 12 * len(fps)  # branches are pruned


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 4000), (4000, 6000)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
    assert got[6000] == got[5000] == got[4000] == 4000
    assert simhash.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = [r for r in awkward_rows() if r[0] is not None]
    texts = {r[0]: r[1] for r in rows if r[0] != 303}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(
        docs(spark, [(k, v, None, None, None) for k, v in texts.items()])).collect()}
    assert got == simhash.brute_force(texts)
    assert got[300] == got[301] == ("0" * 16, 300)


def test_nulls_repeats_and_empty_tables(spark):
    got = simhash.report(docs(spark)).collect()
    assert len(got) == len(awkward_rows())
    assert {r.component_id for r in got if r.doc_id is None and r.fingerprint != "0" * 16} == {None}
    assert simhash.report(docs(spark, [])).collect() == []
    assert simhash.deduplicate(docs(spark, [])).collect() == []


def test_deduplicate_keeps_one_of_each_component(spark):
    df = clashing(docs(spark))
    out = simhash.deduplicate(df)
    assert out.schema == df.schema
    kept = out.collect()
    of = simhash.report(docs(spark)).collect()
    # one row a component; components with the same least id differ in their fingerprints' roots
    assert len(kept) == len({(r.component_id, r.fingerprint) for r in of
                             if r.doc_id == r.component_id or r.component_id is None})
    assert sum(r.doc_id == 400 for r in kept) == 1
    assert sum(r.doc_id is not None and 100 <= r.doc_id < 140 for r in kept) == 1


def test_shingles():
    assert len(simhash.shingle_hashes("One  two\nthree four")) == 2
    assert (simhash.shingle_hashes("ONE two") == simhash.shingle_hashes("one TWO")).all()
    assert (simhash.shingle_hashes("É a") != simhash.shingle_hashes("é a")).all()  # A-Z alone changes case
    rng = random.Random(1)
    long = sentence(rng, 20_000)
    h = simhash.shingle_hashes(long)
    assert simhash.fingerprint(h) == simhash.fingerprint(h, step=777)


def test_rows_with_an_equal_64_bit_hash_stay_apart(spark, monkeypatch):
    """Either half of a row's hash alone tells rows apart."""
    from pyspark.sql import functions as F
    from fraudlens.llm import common
    want = sorted(map(str, simhash.deduplicate(docs(spark)).collect()))
    for half in ("a", "b"):
        monkeypatch.setattr(simhash, "row_hash", lambda cols, half=half: F.struct(
            *[F.lit(7).cast("long").alias(h) if h == half else common.row_hash(cols)[h].alias(h) for h in ("a", "b")]))
        assert sorted(map(str, simhash.deduplicate(docs(spark)).collect())) == want
