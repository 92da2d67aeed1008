"""SimHash near-duplicates: exact pairs within a bit distance by vantage-point trees.

1. *Fingerprints.* Each text gives one 64-bit fingerprint from the XXH64 values
   of its word shingles (repeats included); rows with equal fingerprints are
   collapsed before anything is compared.
2. *Vantage-point tree.* A bounded sample of fingerprints, chosen by hash, builds
   a tree on the driver: a node holds a vantage fingerprint v and a radius r;
   fingerprints with distance to v of at most r go inside, the others outside.
   Its leaves are the shards. Every fingerprint has one home shard. By the
   triangle inequality a fingerprint x inside can have a neighbour y outside at
   distance d or less only if dist(x, v) > r - d; only then x also visits the outer
   branch. Visiting in this one direction finds every pair across a boundary.
3. *Shards.* Each shard compares its visitors and members with its members. Inside,
   another vantage point orders the members by distance, and the triangle bound
   leaves a ring of them to compare. A shard above its size limit is dealt out in
   blocks of members by blocks of visitors, so no task holds a large one whole.
   A task emits a spanning forest of the links it finds, not all pairs.
4. *Components.* Alternating label propagation over the links (DataFrame joins,
   one written table a round) gives each fingerprint the smallest fingerprint
   reachable.

Every fingerprint is indexed and every pair within the distance is found: the
sample only shapes the tree.

Defined results: texts have no length limit; columns may have any names; null and empty texts have fingerprint zero
and link like any other; rows with a null doc_id take part, and a component id is the smallest non-null doc_id of its
rows (null if there is none); repeated rows share a fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraudlens.functions.joins import MAX_BROADCAST_ROWS
from fraudlens.llm.common import bounded_batches, free_name, row_hash, staged

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints a shard aims at, sample rows per shard, and the most shards a tree has (its broadcast size).
SHARD_SIZE = 1024
SAMPLE_PER_SHARD = 16
MAX_SHARDS = 65536
#: Members and visitors that one comparing task takes at most (on average; blocks are dealt by hash).
BLOCK_MEMBERS = 4096
BLOCK_VISITORS = 16384

_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


# ---- fingerprints ---------------------------------------------------------------------------------------------

def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle of the text, as unsigned 64-bit integers.

    ``bytes.lower`` changes A-Z only. Words joined by one space make every
    shingle a slice."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1:].tolist())), np.uint64,
                       len(words) - k + 1)


def fingerprint(hashes: np.ndarray, step: int = 4096) -> int:
    """Bits set in over half of the hashes; summed in steps of bounded size."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), step):
        bits = np.unpackbits(hashes[i:i + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprints(shingle: int = SHINGLE):
    """UDF text -> fingerprint as a signed long."""

    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts],
                                     np.uint64).astype(np.int64))

    return of


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---- vantage-point tree ---------------------------------------------------------------------------------------

def distances(fps: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(fps ^ v).astype(np.int16)


class Tree:
    """Arrays of a vantage-point tree. Node i has children inner[i], outer[i]; a
    negative child -1-s is shard s."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.inner: list[int] = []
        self.outer: list[int] = []
        self.shards = 0
        self.root = self._build(np.unique(sample), max(1, len(sample) // max(1, shards)))

    def _build(self, fps: np.ndarray, leaf: int) -> int:
        if len(fps) <= max(2, leaf):
            self.shards += 1
            return -self.shards
        # The vantage point, of a few, whose distances spread widest: fewest fingerprints lie near its boundary.
        tries = fps[:: max(1, len(fps) // 8)][:8]
        ds = [distances(fps, v) for v in tries]
        best = max(range(len(ds)), key=lambda i: float(ds[i].std()))
        d = ds[best]
        radius = int(np.median(d))
        if (d <= radius).all():
            radius -= 1
        inside = d <= radius
        if not inside.any() or inside.all():
            self.shards += 1
            return -self.shards
        node = len(self.vantage)
        self.vantage.append(int(tries[best]))
        self.radius.append(radius)
        self.inner.append(0)
        self.outer.append(0)
        self.inner[node] = self._build(fps[inside], leaf)
        self.outer[node] = self._build(fps[~inside], leaf)
        return node

    def visits(self, fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, positions in fps that visit it, whether it is their home)."""
        todo = [(self.root, np.arange(len(fps)), np.ones(len(fps), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                yield -1 - node, at, home
                continue
            d = distances(fps[at], np.uint64(self.vantage[node]))
            inside = d <= self.radius[node]
            # Who has its home inside and lies near the boundary visits the outer branch as well. A visitor of
            # this node looks for members on both sides as far as the triangle bound allows.
            go_in = np.where(home, inside, d <= self.radius[node] + bits)
            go_out = ~inside | (d > self.radius[node] - bits)
            todo.append((self.inner[node], at[go_in], home[go_in]))
            todo.append((self.outer[node], at[go_out], (home & ~inside)[go_out]))


def build_tree(fps: DataFrame, count: int, shard_size: int = SHARD_SIZE) -> Tree:
    """A tree from a sample by hash of at most MAX_SHARDS * SAMPLE_PER_SHARD fingerprints."""
    shards = min(MAX_SHARDS, max(1, count // shard_size))
    every = max(1, count // (shards * SAMPLE_PER_SHARD))
    most = 2 * MAX_SHARDS * SAMPLE_PER_SHARD
    rows = fps.filter(F.pmod(F.xxhash64("fp"), F.lit(every)) == 0).limit(most).select("fp").collect() \
        if shards > 1 else []
    sample = np.array(sorted(r["fp"] for r in rows), np.int64).astype(np.uint64)
    return Tree(sample, shards)


# ---- links ----------------------------------------------------------------------------------------------------

class Forest:
    """Union-find over positions 0..n-1; remembers the links that joined two sets."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def near_pairs(members: np.ndarray, visitors: np.ndarray, bits: int, step: int = 1 << 20) -> Iterator[tuple]:
    """Blocks of (visitor position, member position) of pairs within ``bits``.

    Members stand in order of their distance to a vantage point; a visitor's
    neighbours lie within ``bits`` of its own distance, one slice of them."""
    v = members[0]
    d = distances(members, v)
    order = np.argsort(d, kind="stable")
    members, d = members[order], d[order]
    dv = distances(visitors, v)
    for ring in np.unique(dv):
        lo, hi = np.searchsorted(d, ring - bits, "left"), np.searchsorted(d, ring + bits, "right")
        at = np.flatnonzero(dv == ring)
        if lo == hi:
            continue
        rows = max(1, step // (hi - lo))
        for i in range(0, len(at), rows):
            part = at[i:i + rows]
            a, b = np.nonzero(np.bitwise_count(visitors[part, None] ^ members[None, lo:hi]) <= bits)
            yield part[a], order[lo + b]


def forest_of(members: np.ndarray, visitors: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (as fingerprints) of a spanning forest of the near pairs."""
    nodes = np.unique(np.concatenate([members, visitors]))
    forest = Forest(len(nodes))
    m, v = np.searchsorted(nodes, members), np.searchsorted(nodes, visitors)
    for a, b in near_pairs(members, visitors, bits):
        x, y = v[a], m[b]
        for i, j in zip(x[x != y].tolist(), y[x != y].tolist()):
            forest.join(i, j)
    return [(int(nodes[i]), int(nodes[j])) for i, j in forest.links]


def larger_arrays(arrays: Iterator[np.ndarray], size: int) -> Iterator[np.ndarray]:
    held: list[np.ndarray] = []
    for a in arrays:
        held.append(a)
        if sum(map(len, held)) >= size:
            yield np.concatenate(held)
            held = []
    if any(map(len, held)):
        yield np.concatenate(held)


def links(fps: DataFrame, bits: int = MAX_BITS, shard_size: int = SHARD_SIZE, block_members: int = BLOCK_MEMBERS,
          block_visitors: int = BLOCK_VISITORS) -> DataFrame:
    """(a, b) of a link set that connects exactly what pairs within ``bits``
    connect, for a table (fp) of distinct fingerprints."""
    spark = fps.sparkSession
    tree = spark.sparkContext.broadcast(build_tree(fps, fps.count(), shard_size))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in larger_arrays((b["fp"].to_numpy() for b in batches), 1 << 15):
            found = list(tree.value.visits(x.astype(np.uint64), bits))
            yield pd.DataFrame({
                "shard": np.repeat([s for s, _, _ in found], [len(at) for _, at, _ in found]),
                "fp": x[np.concatenate([at for _, at, _ in found])],
                "home": np.concatenate([home for _, _, home in found])})

    seen = staged(fps.select("fp").mapInPandas(visit, "shard long, fp long, home boolean"), "visits")
    # At most MAX_SHARDS rows: broadcast.
    blocks = F.broadcast(seen.groupBy("shard").agg(
        F.ceil(F.count_if("home") / block_members).cast("int").alias("nm"),
        F.ceil(F.count(F.lit(1)) / block_visitors).cast("int").alias("nv")).filter("nm > 0"))
    dealt = seen.join(blocks, "shard")
    own_m = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("nm")).cast("int")
    own_v = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("nv")).cast("int")
    role = F.explode(F.concat(
        F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("nv") - 1),
                                          lambda i: F.struct(own_m.alias("m"), i.alias("v"), F.lit(True).alias("member"))))
        .otherwise(F.array().cast("array<struct<m:int,v:int,member:boolean>>")),
        F.transform(F.sequence(F.lit(0), F.col("nm") - 1),
                    lambda i: F.struct(i.alias("m"), own_v.alias("v"), F.lit(False).alias("member")))))

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        x = g["fp"].to_numpy().astype(np.uint64)
        is_member = g["member"].to_numpy()
        members, visitors = x[is_member], x[~is_member]
        found = forest_of(members, visitors, bits) if len(members) and len(visitors) else []
        pairs = np.array(found, np.uint64).reshape(-1, 2).astype(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return dealt.select("shard", "fp", role.alias("r")).select("shard", "r.m", "r.v", "fp", "r.member") \
        .groupBy("shard", "m", "v").applyInPandas(compare, "a long, b long")


# ---- components -----------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest node reachable.

    Large-star / small-star rounds: in each, every node's neighbourhood is
    reduced to its smallest member by a pre-aggregated minimum, and the links are
    rewritten to point there; each round is written to the shared folder. The
    number of links never grows, and rounds grow with the logarithm of the
    longest path."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .filter("u != v").distinct(), "links")
    while True:
        # large star: every larger neighbour of a node links to the node's smallest neighbour (or itself)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = staged(large.filter("u != v").distinct(), "large-star")
        # small star: a node and its smaller neighbours link to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        rewritten = staged(small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
                           .filter("u != v").distinct(), "small-star")
        settled = rewritten.count() == e.count() and not rewritten.exceptAll(e).limit(1).count()
        e = rewritten
        if settled:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# ---- documents ------------------------------------------------------------------------------------------------

def groups(rows: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """For a table (fp, least, first) of distinct fingerprints: fp, and the
    smallest ``least`` and ``first`` of its component."""
    roots = components(links(rows.select("fp"), bits)).withColumnRenamed("node", "fp")
    named = staged(rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "groups")
    least = named.groupBy("root").agg(F.min("least").alias("least"), F.min("first").alias("first"))
    return named.select("fp", "root").join(least, "root")


def report(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    bounded_batches(docs.sparkSession)
    rows = staged(docs.select(F.col("doc_id").alias("id"), fingerprints(shingle)(F.col("text")).alias("fp")), "rows")
    by_fp = staged(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprints")
    of = groups(by_fp.withColumn("first", F.lit(0)), bits)
    return rows.join(of, "fp").select(
        F.col("id").alias("doc_id"), as_hex(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with its own columns: the one with the
    smallest id (nulls last), then the smallest row hash. Equal rows are one.

    Ids and fingerprints decide. Texts stay where they are while the keys of the
    dropped rows are few enough to broadcast, and move once beyond that (or where
    whole rows are repeated)."""
    bounded_batches(docs.sparkSession)
    cols = docs.columns
    rows = docs.select(F.col(id_col).alias("id"), row_hash(cols).alias("h"),
                       fingerprints(shingle)(F.col(text_col)).alias("fp"))
    # pre-aggregated: copies of a row, then rows of a fingerprint
    rows = staged(rows.groupBy("fp", "id", "h").agg(F.count(F.lit(1)).alias("copies")), "rows")
    by_fp = staged(rows.groupBy("fp").agg(
        F.min("id").alias("least"),
        F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h", "copies")).alias("first")), "fingerprints")
    kept = staged(groups(by_fp, bits).select("first.h", "first.copies").distinct(), "kept")
    key = free_name(docs, "row_key")
    dropped = staged(rows.select("h").distinct().join(kept, "h", "left_anti").withColumnRenamed("h", key), "dropped")
    if dropped.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    out = docs.withColumn(key, row_hash(cols)).join(dropped, key, "left_anti")
    if kept.filter("copies > 1").limit(1).count():
        out = out.dropDuplicates([key])
    return out.select(*cols)


def brute_force(texts: dict[int, str | None], shingle: int = SHINGLE, bits: int = MAX_BITS) -> dict[int, tuple]:
    """id -> (fingerprint hex, component id) from all pairs. For tests on small inputs."""
    fps = {}
    for i, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        grams = [" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
        hs = [xxhash.xxh64_intdigest(g.encode(), SEED) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    component = {i: i for i in texts}
    ids = sorted(texts)
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (fps[i] ^ fps[j]).bit_count() <= bits and component[j] < component[i]:
                    component[i] = component[j]
                    changed = True
    return {i: (f"{fps[i]:016x}", component[i]) for i in ids}
