"""Embedding whitening from the exact characteristic polynomial of the scatter matrix.

Entries become integers, x = floor(256 * c), so sums, products and the scatter
matrix C = n * sum(x x') - S S' (n squared times the covariance) are exact.

1. *Scatter.* Each task adds up its distinct vectors exactly (float products that
   stay below 2^53, or Python integers) and emits its d(d+1)/2 sums once; Spark
   adds them by position. The driver holds one d x d matrix.
2. *Polynomial.* det(tI - C) modulo enough primes below 2^31, one Spark row a
   prime: Hessenberg reduction by modular similarity transforms, then the
   recurrence over leading minors. Chinese remaindering gives the integer
   coefficients; Maclaurin's inequality bounds them by the trace.
3. *Roots.* All roots are real, so by Descartes' rule the sign changes of the
   shifted polynomial count the roots beyond a point exactly, multiplicity
   included. Bisection over integers of the polynomial scaled by 2^SCALE_BITS
   gives each of the largest roots to that many binary places.
4. *Components.* Inverse iteration at the root: an LU factorisation of C - root*I
   in decimal arithmetic of DIGITS places; vectors of equal roots are made
   orthogonal. Then rounded to doubles.
5. *Whitening.* One pass projects the centred rows.

Defined results: a vector that is null, holds a null or non-finite entry, or one
whose x does not fit 62 bits is dropped; so are vectors of another length than
the most frequent one (of these, the longest). Repeated rows each get their
result but count once in the fit list, as do different rows with equal x. A null
vec_id stays null. Components of eigenvalue zero have no whitened value and are
left out, so fewer than four may return: none for an empty table, one distinct
vector or empty vectors. Equal eigenvalues give some orthonormal basis of their
space, the same for all rows. ``deviation`` beyond a long is null. Other columns
of the table are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudlens.llm.common import staged

COMPONENTS = 4
#: Binary places to which roots of the scatter matrix are isolated, and decimal places of the null-space solver.
SCALE_BITS = 80
DIGITS = 90
#: Entries c with |256 c| below 2^62 are integers that products with row counts are taken of.
MAX_ENTRY = float(2 ** 54)
LIMB = 60


# ---- integer rows ---------------------------------------------------------------------------------------------

def integer_rows(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of every row that takes part."""
    fit = F.forall(F.col(vector_col), lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < MAX_ENTRY))
    rows = embeddings.filter(F.col(vector_col).isNotNull() & fit).select(
        F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda e: F.floor(e.cast("double") * 256)).alias("x"))
    # one row a length
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("x") == (lengths["d"] if lengths else 0))


def matrix_of(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


# ---- exact scatter --------------------------------------------------------------------------------------------

def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x as an array of Python integers."""
    total = np.zeros((x.shape[1], x.shape[1]), object)
    top = int(np.abs(x).max(initial=0))
    if top * top >= 2 ** 53:
        big = x.astype(object)
        return total + big.T @ big
    step = max(1, min(len(x), (2 ** 53 - 1) // max(1, top * top)))
    for i in range(0, len(x), step):
        part = x[i:i + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, sums, products = 0, None, None
    for b in batches:
        x = matrix_of(b)
        if not len(x):
            continue
        short = int(np.abs(x).max()) * len(x) < 2 ** 62 if x.size else True
        s, p = (x if short else x.astype(object)).sum(axis=0).astype(object), exact_products(x)
        n, sums, products = (n + len(x), s, p) if sums is None else (n + len(x), sums + s, products + p)
    if not n:
        return
    cells = [(-1, -1, n)] + [(i, -1, int(v)) for i, v in enumerate(sums)]
    cells += [(i, j, int(products[i, j])) for i in range(len(sums)) for j in range(i, len(sums))]
    number = pa.decimal128(38, 0)
    yield pa.RecordBatch.from_arrays([
        pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()),
        pa.array([Decimal(c[2] >> LIMB) for c in cells], number),
        pa.array([Decimal(c[2] & (1 << LIMB) - 1) for c in cells], number)], ["i", "j", "hi", "lo"])


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, S and C = n * sum(x x') - S S' of the rows of ``fit`` (x), exactly. d(d+3)/2 + 1 numbers reach the driver."""
    parts = fit.mapInArrow(_partial_sums, "i int, j int, hi decimal(38,0), lo decimal(38,0)")
    cells = {(r.i, r.j): (int(r.hi) << LIMB) + int(r.lo)
             for r in parts.groupBy("i", "j").agg(F.sum("hi").alias("hi"), F.sum("lo").alias("lo")).collect()}
    n = cells.get((-1, -1), 0)
    d = sum(j == -1 for _, j in cells) - (1 if n else 0)
    s = [cells[i, -1] for i in range(d)]
    c = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            c[i, j] = c[j, i] = n * cells[i, j] - s[i] * s[j]
    return n, s, c


# ---- characteristic polynomial --------------------------------------------------------------------------------

def is_prime(p: int) -> bool:
    """Miller-Rabin, certain below 3.2e9 with these bases."""
    if p < 2 or any(p % b == 0 for b in (2, 3, 5, 7)):
        return p in (2, 3, 5, 7)
    odd, twos = p - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for b in (2, 3, 5, 7):
        y = pow(b, odd, p)
        if y in (1, p - 1):
            continue
        if all((y := y * y % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bound: int) -> list[int]:
    """Largest primes below 2^31 whose product exceeds ``bound``."""
    out, product, p = [], 1, 2 ** 31 - 1
    while product <= bound:
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def polynomial_mod(c: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(tI - c) modulo the prime p < 2^31, lowest first."""
    h = (c % p).astype(np.int64)
    d = len(h)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        if i != m:
            h[[i, m]] = h[[m, i]]
            h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1:, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1:] = (h[m + 1:] - u[:, None] * h[m]) % p
        h[:, m] = (h[:, m] + (h[:, m + 1:] * u % p).sum(axis=1)) % p
    poly = np.zeros((d + 1, d + 1), np.int64)
    poly[0, 0] = 1
    for k in range(1, d + 1):
        # expansion along the last column of the leading k x k block: entry times the product of subdiagonals below it
        weights, product = np.zeros(k, np.int64), 1
        for row in range(k - 1, -1, -1):
            weights[row] = int(h[row, k - 1]) * product % p
            product = product * int(h[row, row - 1]) % p if row else 0
        poly[k, 1:] = poly[k - 1, :-1]
        poly[k] = (poly[k] - (weights[:, None] * poly[:k] % p).sum(axis=0)) % p
    return poly[d]


def coefficient_bound(c: np.ndarray) -> int:
    """No coefficient of det(tI - c) is larger, c being positive semidefinite (Maclaurin's inequality)."""
    d, trace = len(c), int(sum(c[i, i] for i in range(len(c))))
    return max(math.comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1)) if d else 1


def remainder(residues: list[int], primes: list[int]) -> int:
    """The integer nearest zero with these residues, by Garner's mixed radix digits."""
    value, product = 0, 1
    for r, p in zip(residues, primes):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


def characteristic_polynomial(spark: SparkSession, c: np.ndarray) -> list[int]:
    """Integer coefficients of det(tI - c), lowest first; a Spark row for each prime."""
    primes = primes_beyond(2 * coefficient_bound(c))
    rows = spark.createDataFrame([(p,) for p in primes], "p long") \
        .repartition(min(len(primes), spark.sparkContext.defaultParallelism))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([
                pa.array(ps, pa.int64()), pa.array([polynomial_mod(c, p).tolist() for p in ps], pa.list_(pa.int64()))],
                ["p", "coefficients"])

    found = {r.p: r.coefficients for r in rows.mapInArrow(reduce, "p long, coefficients array<long>").collect()}
    return [remainder([found[p][k] for p in primes], primes) for k in range(len(c) + 1)]


# ---- roots and components -------------------------------------------------------------------------------------

def roots_beyond(poly: list[int], a: int) -> int:
    """How many roots exceed a, for a polynomial with real roots only (Descartes' rule, exact here)."""
    q = list(poly)
    if a:
        for i in range(len(q) - 1):  # Taylor shift by Horner's scheme
            for j in range(len(q) - 2, i - 1, -1):
                q[j] += a * q[j + 1]
    signs = [v > 0 for v in q if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], trace: int, count: int = COMPONENTS, bits: int = SCALE_BITS) -> list[int]:
    """The largest positive roots times 2^bits, rounded up, falling."""
    d = len(poly) - 1
    scaled = [v << bits * (d - i) for i, v in enumerate(poly)]
    out: list[int] = []
    high = (trace << bits) + 1
    for j in range(1, min(count, roots_beyond(poly, 0)) + 1):
        lo, hi = 0, high  # more than j - 1 roots lie beyond lo, and not beyond hi
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if roots_beyond(scaled, mid) >= j else (lo, mid)
        out.append(hi)
        high = hi
    return out


def _factor(a: list[list[Decimal]], tiny: Decimal) -> list[int]:
    """LU factors of ``a`` in place, with partial pivoting; a pivot of zero becomes ``tiny``."""
    d, order = len(a), list(range(len(a)))
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(a[r][k]))
        a[k], a[i] = a[i], a[k]
        order[k], order[i] = order[i], order[k]
        row = a[k]
        row[k] = row[k] or tiny
        for r in range(k + 1, d):
            if a[r][k]:
                f = a[r][k] = a[r][k] / row[k]
                a[r][k + 1:] = [x - f * y for x, y in zip(a[r][k + 1:], row[k + 1:])]
    return order


def _solve(lu: list[list[Decimal]], order: list[int], b: list[Decimal]) -> list[Decimal]:
    x = [b[i] for i in order]
    d = len(x)
    for i in range(d):
        x[i] -= sum((lu[i][j] * x[j] for j in range(i)), Decimal(0))
    for i in range(d - 1, -1, -1):
        x[i] = (x[i] - sum((lu[i][j] * x[j] for j in range(i + 1, d)), Decimal(0))) / lu[i][i]
    return x


def null_vectors(c: np.ndarray, roots: list[int], bits: int = SCALE_BITS, digits: int = DIGITS) -> np.ndarray:
    """Unit eigenvectors of c at its roots (times 2^bits), one a row; the largest entry of each is positive."""
    d = len(c)
    out: list[list[Decimal]] = []
    with localcontext() as context:
        context.prec = digits + len(str(int(np.abs(c).max(initial=0))))
        tiny = Decimal(10) ** -digits
        for j, root in enumerate(roots):
            shift = Decimal(root) / (1 << bits)
            lu = [[Decimal(int(c[i, k])) - (shift if i == k else 0) for k in range(d)] for i in range(d)]
            order = _factor(lu, tiny)
            # any start that is not orthogonal to the space will do
            x = [Decimal(1) + Decimal((i * 7919 + j * 104729) % 1009) / 1009 for i in range(d)]
            for _ in range(4):
                x = _solve(lu, order, x)
                for _ in range(2):  # orthogonal to the components found: one of equal roots gives another vector
                    for v in out:
                        along = sum(s * t for s, t in zip(x, v))
                        x = [s - along * t for s, t in zip(x, v)]
                length = sum(s * s for s in x).sqrt()
                x = [s / length for s in x]
            lead = max(range(d), key=lambda i: abs(x[i]))
            out.append([-s for s in x] if x[lead] < 0 else x)
        return np.array([[float(s) for s in v] for v in out], np.float64).reshape(len(out), d)


# ---- whitening ------------------------------------------------------------------------------------------------

class Whitening:
    """Fitted on a list of distinct integer vectors; ``components`` are rows."""

    def __init__(self, spark: SparkSession, fit: DataFrame, count: int = COMPONENTS):
        self.n, self.sums, c = scatter(fit)
        # the polynomial of c over its common divisor has smaller coefficients and the same null spaces
        common = math.gcd(*(int(v) for v in c.flat)) if len(c) else 0
        self.roots: list[int] = []
        self.components = np.zeros((0, len(c)))
        self.explained = self.eigenvalues = np.zeros(0)
        if not common:
            return
        c = c // common
        trace = int(sum(c[i, i] for i in range(len(c))))
        self.roots = largest_roots(characteristic_polynomial(spark, c), trace, count)
        self.components = null_vectors(c, self.roots)
        self.eigenvalues = np.array([r * common / (self.n * self.n << SCALE_BITS) for r in self.roots])
        self.explained = np.array([r / (trace << SCALE_BITS) for r in self.roots])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: long where that holds it, else Python integers."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        exact = np.int64 if most < 2 ** 62 else object
        return x.astype(exact) * exact(self.n) - np.array(self.sums, exact) if exact is np.int64 \
            else x.astype(object) * self.n - np.array(self.sums, object)

    def deviations(self, y: np.ndarray) -> list[int | None]:
        most = int(np.abs(y).max(initial=0)) ** 2 * y.shape[1]
        if y.dtype == np.int64 and most < 2 ** 63:
            return (y * y).sum(axis=1).tolist()
        return [v if v < 2 ** 63 else None for v in (y.astype(object) ** 2).sum(axis=1).tolist()]

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """A column for each component."""
        return (y.astype(np.float64) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)


def _identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured over its rows."""
    k = len(w.roots)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z = w.whitened(w.centred(matrix_of(b)))
                yield pa.RecordBatch.from_arrays([pa.array(z[:, i]) for i in range(k)], [f"w{i}" for i in range(k)])

    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = fit.mapInArrow(project, ", ".join(f"w{i} double" for i in range(k))) \
        .agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def report(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           count: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    spark = embeddings.sparkSession
    rows = integer_rows(embeddings, id_col, vector_col)
    fit = staged(rows.select("x").distinct(), "fit")
    w = Whitening(spark, fit, count)
    k = len(w.roots)
    error = _identity_error(fit, w) if k else None
    id_type = rows.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = b.num_rows
            if not m or not k:
                continue
            y = w.centred(matrix_of(b))
            at = np.repeat(np.arange(m), k)
            ids = b.column(b.schema.get_field_index("vec_id"))
            yield pa.RecordBatch.from_arrays([
                ids.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, w.n, np.int64)), pa.array(w.deviations(y), pa.int64()).take(pa.array(at)),
                pa.array(w.whitened(y).ravel()), pa.array(np.tile(w.explained, m)),
                pa.array(np.full(m * k, error))], names)

    return rows.mapInArrow(project, f"vec_id {id_type}, component int, n long, deviation long, whitened double, "
                                    "explained double, identity_error double")
