"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

1. *Vectors.* Equal vectors are one entry with the k + 1 smallest of its ids; no
   other id of it can be among the k nearest of any query. (The limit is applied
   before the shuffle, so a hot vector costs a few rows a task.)
2. *Hashing.* With M the largest norm, x becomes the unit vector (x, sqrt(M^2 - |x|^2)) / M
   and a query (q, 0) / |q|: the nearest by distance are those of largest inner
   product. Each table has ``m`` normal projections, cut at random offsets into
   intervals of WIDTH; a bucket is a cell of m interval numbers. ``m`` grows with the
   logarithm of the rows and falls while there are over MAX_CELLS occupied cells.
3. *Probes.* For a neighbour at distance r a projection differs by a normal variable of
   deviation r, so a cell's chance of success is a product of normal masses. A query
   probes the occupied cells (its own and perturbed ones) in falling order of that
   chance, until they hold a share of the chance of all of them.
4. *Fitting.* r and the share come from FIT_QUERIES sample queries (by hash of the vector),
   whose true neighbours one scan finds exactly: r is their median distance, the share
   the smallest at which one of the tables reaches FIT_RECALL of them. Every row is indexed.
5. *Reranking.* Cells, in order, are dealt into tiles of about TILE_ROWS rows; larger cells are
   split by hash, queries into blocks, so that no task holds more than a tile and a block. A
   task computes exact inner products of its probed pairs and keeps the k + 1 best of each
   query; all tables' are merged.

There is no cap on the rows of a bucket or on probes or candidates.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component takes no part, as query
or candidate. Vectors are compared with those of their own length only. Queries are rows whose id is
divisible by ``every`` (null ids are none); each such row has its result, repeated rows each the same one, and a
repeated row is a candidate like any other. Ties go to the smaller id, nulls last. A query without candidates returns
no rows; an empty table none. Other columns of the table are never read. Sums of products are in double precision, in
one fixed order for all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudlens.llm.common import staged

K = 20
EVERY = 20
SEED = 20
TABLES = 2
#: Interval of a projection in its standard deviations; rows a cell aims at; projections a table may have.
WIDTH = 1.0
CELL_ROWS = 256
MAX_PROJECTIONS = 12
#: Occupied cells of all tables: every task that probes holds this directory.
MAX_CELLS = 65536
TILE_ROWS = 8192
BLOCK_QUERIES = 4096
FIT_QUERIES = 256
FIT_RECALL = 0.96

LAST_ID = 2 ** 63 - 1


# ---- vectors --------------------------------------------------------------------------------------------------

def distinct_vectors(embeddings: DataFrame, id_col: str, vector_col: str, every: int, k: int) -> DataFrame:
    """(key, v array<double>, ids, first, asked): each distinct vector with its k + 1 smallest ids (nulls last)."""
    v = F.col(vector_col)
    sound = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))) \
        & F.exists(v, lambda e: e != 0)
    rows = embeddings.filter(v.isNotNull() & sound).select(
        F.transform(v, lambda e: e.cast("double") + 0.0).alias("v"), F.col(id_col).cast("long").alias("id"))
    w = Window.partitionBy("v").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    found = few.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("r", "id"))).alias("ids"))
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).select("v").distinct().withColumn("asked", F.lit(True))
    out = found.join(asked, "v", "left").select(
        F.monotonically_increasing_id().alias("key"), "v", F.col("ids.id").alias("ids"),
        F.coalesce(F.col("ids")[0]["id"], F.lit(LAST_ID)).alias("first"),
        F.coalesce("asked", F.lit(False)).alias("asked"))
    return staged(out, "vectors")


def matrices(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row positions, matrix) of the vectors of each length in a batch."""
    col = b.column(b.schema.get_field_index("v"))
    sizes = np.diff(col.offsets.to_numpy())
    flat = col.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, flat[(ends[at] - d)[:, None] + np.arange(d)]


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, each summed in the same order."""
    return np.ascontiguousarray(q * c).sum(axis=1)


def best_pairs(q: np.ndarray, c: np.ndarray, first: np.ndarray, k: int,
               allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, candidate position, score) of the k best candidates of each query: largest inner
    product, then smallest ``first``. ``allowed`` (query x candidate) names the pairs that count.

    A matrix product leaves what can be among the best within its rounding error; these are computed again."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    norm = np.sqrt((c * c).sum(axis=1)).max(initial=0.0)
    step = max(1, (1 << 22) // max(1, len(c)))
    for i in range(0, len(q), step):
        part = q[i:i + step]
        s = part @ c.T
        if allowed is not None:
            s[~allowed[i:i + step]] = -np.inf
        if len(c) > k:
            kth = np.partition(s, len(c) - k, axis=1)[:, len(c) - k]
        else:
            kth = np.full(len(part), -np.inf)
        slack = 1e-14 * (1 + part.shape[1]) * norm * np.sqrt((part * part).sum(axis=1))
        a, b = np.nonzero((s >= (kth - slack)[:, None]) & (s > -np.inf))
        exact = scores(part[a], c[b])
        order = np.lexsort((first[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        rank = np.arange(len(a)) - np.searchsorted(a, a, "left")
        keep = rank < k
        out.append((a[keep] + i, b[keep], exact[keep]))
    if not out:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*out))


# ---- hashing --------------------------------------------------------------------------------------------------

def projections(d: int, tables: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Normal directions (d + 1, tables * m) and offsets, the same everywhere; with fewer projections, the first of each
    table."""
    rng = np.random.default_rng([SEED, d])
    a = rng.standard_normal((tables, MAX_PROJECTIONS, d + 1))[:, :m]
    b = rng.uniform(0, WIDTH, (tables, MAX_PROJECTIONS))[:, :m]
    return a.reshape(tables * m, d + 1).T, b.reshape(tables * m)


def projected(v: np.ndarray, top: float, tables: int, m: int, query: bool) -> np.ndarray:
    """(rows, tables, m) projections of the augmented unit vectors."""
    norm2 = (v * v).sum(axis=1)
    if query:
        unit, rest = v / np.sqrt(norm2)[:, None], np.zeros(len(v))
    else:
        unit, rest = v / top, np.sqrt(np.maximum(0.0, 1.0 - norm2 / (top * top)))
    a, b = projections(v.shape[1], tables, m)
    return (np.column_stack([unit, rest]) @ a + b).reshape(len(v), tables, m)


def cells_of(vectors: DataFrame, top: float, tables: int, m: int) -> DataFrame:
    """``vectors`` with ``cells``: m interval numbers for each table."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = np.zeros((b.num_rows, tables, m), np.int16)
            for at, v in matrices(b):
                cells[at] = np.floor(projected(v, top, tables, m, False) / WIDTH)
            flat = pa.array(cells.ravel())
            inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, m), pa.int32()), flat)
            outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(inner) + 1, tables), pa.int32()), inner)
            yield pa.RecordBatch.from_arrays([*b.columns, outer], [*b.schema.names, "cells"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return staged(vectors.mapInArrow(hashed, f"{kinds}, cells array<array<short>>"), "cells")


def normal_mass(x: np.ndarray) -> np.ndarray:
    """The standard normal distribution function (to 1.5e-7)."""
    z = np.abs(x) / np.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = 0.5 * (1.0 - tail * np.exp(-z * z))
    return 0.5 + np.sign(x) * half


class Directory:
    """Occupied cells of every table and vector length, with their rows, tile and splits. ``cells[t, d]`` is an array
    (cells, m); a cell's global number is its place in the order of (t, d) and cell."""

    def __init__(self, counted: pd.DataFrame, m: int, tile_rows: int):
        counted = counted.sort_values(["t", "d", "cell"]).reset_index(drop=True)
        self.m, self.at, self.cells = m, {}, {}
        rows = counted["n"].to_numpy(np.int64)
        self.splits = np.maximum(1, -(-rows // tile_rows))
        tile, held, tiles, last = -1, tile_rows, [], None
        for t, d, n, s in zip(counted["t"], counted["d"], rows, self.splits):
            if held + n > tile_rows or s > 1 or (t, d) != last:
                tile, held = tile + 1, 0
            tiles.append(tile)
            held, last = held + n, (t, d)
        self.tile = np.array(tiles, np.int64)
        for (t, d), g in counted.groupby(["t", "d"]):
            self.at[t, d] = int(g.index[0])
            self.cells[t, d] = np.array(g["cell"].tolist(), np.float64).reshape(-1, m)

    def chances(self, t: int, d: int, p: np.ndarray, r: float) -> np.ndarray:
        """(rows of p, cells): the chance that a neighbour at distance r of each projected query lies in a cell."""
        lo = self.cells[t, d] * WIDTH
        out = np.ones((len(p), len(lo)))
        for i in range(self.m):
            edges, where = np.unique(lo[:, i], return_inverse=True)
            gap = edges[None, :] - p[:, i, None]
            out *= (normal_mass((gap + WIDTH) / r) - normal_mass(gap / r))[:, where]
        return out

    def probes(self, t: int, d: int, p: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers in falling order of success for each query, and the share of the chance that the cells before
        each hold."""
        chance = self.chances(t, d, p, r)
        order = np.argsort(-chance, axis=1, kind="stable")
        ranked = np.take_along_axis(chance, order, axis=1)
        before = np.cumsum(ranked, axis=1) - ranked
        return order, before / np.maximum(ranked.sum(axis=1), 1e-300)[:, None]


def directory(cells: DataFrame, m: int, tables: int, tile_rows: int, max_cells: int = MAX_CELLS) -> Directory:
    """Drops projections until at most ``max_cells`` cells are occupied; the driver holds these."""
    each = cells.select(F.size("v").alias("d"), F.posexplode("cells").alias("t", "cell"))
    counts = staged(each.groupBy("t", "d", "cell").agg(F.count(F.lit(1)).alias("n")), "counts")
    while True:
        cut = counts.groupBy("t", "d", F.slice("cell", 1, m).alias("cell")).agg(F.sum("n").alias("n"))
        if m == 1 or cut.limit(max_cells + 1).count() <= max_cells:
            rows = cut.collect()
            return Directory(pd.DataFrame([(r.t, r.d, tuple(r.cell), r.n) for r in rows],
                                          columns=["t", "d", "cell", "n"]), m, tile_rows)
        m -= 1


# ---- fitting --------------------------------------------------------------------------------------------------

def exact_neighbours(vectors: DataFrame, sample: list[np.ndarray], k: int) -> list[list[tuple[float, np.ndarray]]]:
    """The k nearest other vectors (score, vector) of each sample vector, from one scan."""
    by_length: dict[int, list[int]] = {}
    for i, q in enumerate(sample):
        by_length.setdefault(len(q), []).append(i)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, np.ndarray]]] = {}
        for b in batches:
            keys = b.column(b.schema.get_field_index("key")).to_numpy()
            for at, v in matrices(b):
                which = by_length.get(v.shape[1], [])
                if not which:
                    continue
                a, c, s = best_pairs(np.array([sample[i] for i in which]), v, keys[at], k + 1)
                for i, j, x in zip(a.tolist(), c.tolist(), s.tolist()):
                    best.setdefault(which[i], []).append((x, int(keys[at[j]]), v[j]))
            for i, found in best.items():
                best[i] = sorted(found, key=lambda f: (-f[0], f[1]))[:k + 1]
        flat = [(i, s, key, v) for i, found in best.items() for s, key, v in found]
        yield pa.RecordBatch.from_arrays([
            pa.array([f[0] for f in flat], pa.int32()), pa.array([f[1] for f in flat], pa.float64()),
            pa.array([f[2] for f in flat], pa.int64()), pa.array([f[3].tolist() for f in flat], pa.list_(pa.float64()))],
            ["q", "s", "key", "v"])

    w = Window.partitionBy("q").orderBy(F.desc("s"), "key")
    found = vectors.select("key", "v").mapInArrow(scan, "q int, s double, key long, v array<double>") \
        .withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1).collect()
    out: list[list[tuple[float, np.ndarray]]] = [[] for _ in sample]
    for row in sorted(found, key=lambda f: f.r):
        v = np.array(row.v)
        if len(out[row.q]) < k and not np.array_equal(v, sample[row.q]):
            out[row.q].append((row.s, v))
    return out


def fit(vectors: DataFrame, where: Directory, top: float, tables: int, k: int,
        queries: int = FIT_QUERIES, recall: float = FIT_RECALL) -> tuple[float, float]:
    """(distance r, share of the chance to probe) from a bounded sample of queries; the k nearest of these are exact."""
    rows = vectors.filter("asked").select("v", F.xxhash64("v").alias("h")).orderBy("h").limit(queries).collect()
    sample = [np.array(r.v) for r in rows]
    near = exact_neighbours(vectors, sample, k) if sample else []
    far = [np.sqrt(max(0.0, 2 - 2 * s / (top * np.sqrt(q @ q)))) for q, found in zip(sample, near) for s, _ in found]
    r = max(float(np.median(far)), 0.05) if far else 1.0
    needed = []
    for q, found in zip(sample, near):
        if not found:
            continue
        d = len(q)
        p = projected(q[None, :], top, tables, where.m, True)
        homes = np.floor(projected(np.array([v for _, v in found]), top, tables, where.m, False) / WIDTH)
        least = np.full(len(found), np.inf)
        for t in range(tables):
            order, before = where.probes(t, d, p[:, t], r)
            place = {tuple(c): before[0, i] for i, c in enumerate(where.cells[t, d][order[0]])}
            least = np.minimum(least, [place[tuple(h)] for h in homes[:, t]])
        needed += least.tolist()
    return r, float(np.quantile(needed, recall, method="higher")) if needed else 1.0


# ---- search ---------------------------------------------------------------------------------------------------

def candidates(vectors: DataFrame, where: Directory, top: float, tables: int, r: float, share: float, k: int,
               block_queries: int) -> DataFrame:
    """(q, c, score) by vector keys: each query's k best of every tile that it probes."""
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(where)
    blocks = max(1, -(-vectors.filter("asked").count() // block_queries))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the tile of its cell once for every block of queries; each query to the tiles it probes."""
        w: Directory = shared.value
        numbers = {key: {tuple(c): i for i, c in enumerate(cells.tolist())} for key, cells in w.cells.items()}
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index("key")).to_numpy()
            first = b.column(b.schema.get_field_index("first")).to_numpy()
            asked = b.column(b.schema.get_field_index("asked")).to_numpy(zero_copy_only=False)
            cells = b.column(b.schema.get_field_index("cells")).to_pylist()
            vs = b.column(b.schema.get_field_index("v"))

            def placed(part: list[tuple]) -> pa.RecordBatch:
                """part: (tile, split, block, is query, row in the batch, cells; one for a candidate)."""
                take = pa.array([x[4] for x in part], pa.int64())
                return pa.RecordBatch.from_arrays([
                    pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.int32()),
                    pa.array([x[2] for x in part], pa.int32()), pa.array([x[3] for x in part], pa.bool_()),
                    pa.array(keys).take(take), pa.array(first).take(take), vs.take(take),
                    pa.array([x[5] for x in part], pa.list_(pa.int32()))],
                    ["tile", "split", "block", "query", "key", "first", "v", "probed"])

            rows: list[tuple] = []
            for at, v in matrices(b):
                d = v.shape[1]
                for i in at.tolist():
                    for t in range(tables):
                        cell = numbers[t, d][tuple(cells[i][t][:w.m])]
                        g = w.at[t, d] + cell
                        split = int(keys[i]) * 2654435761 % 4294967291 % int(w.splits[g])
                        for block in range(blocks):
                            rows.append((int(w.tile[g]), split, block, False, i, [cell]))
                            if len(rows) == 4096:
                                yield placed(rows)
                                rows = []
                q = np.flatnonzero(asked[at])
                for lo in range(0, len(q), 64):
                    part = q[lo:lo + 64]
                    p = projected(v[part], top, tables, w.m, True)
                    for t in range(tables):
                        order, before = w.probes(t, d, p[:, t], r)
                        for x, i in enumerate(at[part].tolist()):
                            probed = order[x, :np.searchsorted(before[x], share, "right")]
                            tiles = w.tile[w.at[t, d] + probed]
                            by = np.argsort(tiles, kind="stable")
                            cuts = np.flatnonzero(np.diff(tiles[by])) + 1
                            block = int(keys[i]) * 2246822519 % 4294967291 % blocks
                            for mine in np.split(probed[by], cuts):
                                g = w.at[t, d] + mine[0]
                                for split in range(int(w.splits[g])):
                                    rows.append((int(w.tile[g]), split, block, True, i, mine.tolist()))
                                if len(rows) >= 4096:
                                    yield placed(rows)
                                    rows = []
            if rows:
                yield placed(rows)

    def compare(g: pa.Table) -> pa.Table:
        b = g.combine_chunks()
        query = b.column("query").to_numpy()
        keys, first = b.column("key").to_numpy(), b.column("first").to_numpy()
        v = np.array(b.column("v").to_pylist(), np.float64)  # a tile holds one length
        probed = b.column("probed").to_pylist()
        qs, cs = np.flatnonzero(query), np.flatnonzero(~query)
        qs = qs[np.argsort(keys[qs])]
        home, inverse = np.unique([probed[i][0] for i in cs], return_inverse=True) if len(cs) else ([], [])
        allowed = np.zeros((len(qs), len(home)), bool)
        for x, i in enumerate(qs.tolist()):
            allowed[x, np.searchsorted(home, np.intersect1d(probed[i], home))] = True
        a, c, s = best_pairs(v[qs], v[cs], first[cs], k, allowed[:, inverse] if len(cs) else None) \
            if len(qs) and len(cs) else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"q": pa.array(keys[qs][a], pa.int64()), "c": pa.array(keys[cs][c], pa.int64()),
                         "score": pa.array(s, pa.float64())})

    return vectors.mapInArrow(deal, "tile int, split int, block int, query boolean, key long, first long, "
                                    "v array<double>, probed array<int>") \
        .groupBy("tile", "split", "block").applyInArrow(compare, "q long, c long, score double")


def search(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, every: int = EVERY,
           tables: int = TABLES, cell_rows: int = CELL_ROWS, tile_rows: int = TILE_ROWS,
           block_queries: int = BLOCK_QUERIES, max_cells: int = MAX_CELLS, recall: float = FIT_RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found of each row whose id is divisible by ``every``."""
    vectors = distinct_vectors(embeddings, id_col, vector_col, every, k)
    size = vectors.agg(F.count(F.lit(1)).alias("n"),
                       F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))).alias("top")).first()
    top = size["top"] or 1.0
    m = int(np.clip(round(np.log2(max(1, size["n"]) / cell_rows) / 2), 1, MAX_PROJECTIONS))
    cells = cells_of(vectors, top, tables, m)
    where = directory(cells, m, tables, tile_rows, max_cells)
    r, share = fit(cells, where, top, tables, k, recall=recall)
    pairs = candidates(cells, where, top, tables, r, share, k + 1, block_queries)

    # The same pair can come from several tables, with the same score. k + 1 vectors hold at least k other rows.
    firsts = cells.select(F.col("key").alias("c"), "first", "ids")
    named = pairs.groupBy("q", "c").agg(F.max("score").alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "first", "c")
    best = named.join(firsts.select("c", "first"), "c").withColumn("r", F.row_number().over(w)) \
        .filter(F.col("r") <= k + 1).join(firsts.select("c", "ids"), "c")
    entry = F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.isNull().alias("no_id"),
                                                            i.alias("id"), (F.col("q") == F.col("c")).alias("own"))))
    # at most (k + 1)^2 entries a query vector
    lists = best.select("q", entry.alias("e")).groupBy("q").agg(
        F.slice(F.sort_array(F.collect_list("e")), 1, k + 1).alias("e"))
    asked = staged(cells.filter("asked").select(F.col("key").alias("q"), "v").join(lists, "q").select("v", "e"), "lists")

    v = F.col(vector_col)
    queries = embeddings.filter(F.pmod(F.col(id_col).cast("long"), F.lit(every)) == 0).select(
        F.col(id_col).alias("query_id"), F.transform(v, lambda e: e.cast("double") + 0.0).alias("v"))
    own = F.expr("array_position(transform(e, x -> x.own and x.id = query_id), true)")
    others = F.when(F.col("own") > 0, F.concat(F.slice("e", F.lit(1), F.col("own").cast("int") - 1),
                                               F.slice("e", F.col("own").cast("int") + 1, F.lit(k + 1)))) \
        .otherwise(F.col("e"))
    return queries.join(asked, "v").withColumn("own", own) \
        .select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x")) \
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("vec_id"),
                (-F.col("x.s")).alias("score"))


def report(embeddings: DataFrame) -> DataFrame:
    return search(embeddings)


def brute_force(rows: list[tuple], k: int = K, every: int = EVERY) -> dict[int, list[list[tuple[int, float]]]]:
    """query id -> (vec_id, score) lists, one a query row. For tests on small inputs."""
    good = [(i, np.array(v, np.float64)) for i, v in rows
            if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out: dict[int, list[list[tuple[int, float]]]] = {}
    for at, (q, x) in enumerate(good):
        if q is None or q % every:
            continue
        found = [(-float((x * y).sum()), i is None, i or 0, i) for b, (i, y) in enumerate(good)
                 if b != at and len(y) == len(x)]
        out.setdefault(q, []).append([(i, -s) for s, _, _, i in sorted(found, key=lambda f: f[:3])[:k]])
    return out
