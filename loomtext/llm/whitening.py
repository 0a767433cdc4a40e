"""Whitening of vectors by the exact characteristic polynomial of their scatter.

Components become integers floor(64 c); their scatter n G - S S' (G: sums of products, S: sums) is n^2 times the covariance
and is summed exactly, in blocks. Its characteristic polynomial is found modulo 31-bit primes, by reduction to Hessenberg
form, and put together by Chinese remaindering; tasks take the primes. All its roots are real, so the sign changes of
shifted coefficients count the roots above a point exactly, with multiplicity: bisection isolates the roots, Newton's steps
refine them to hundreds of bits. Inverse iteration in integers of fixed point gives each root's null space; tasks take the
roots. Nothing on the driver is larger than the scatter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from math import ceil, comb, gcd, isqrt, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import table

#: Steps of a component's unit, what is added to a component, components that come out, magnitudes from which on a component
#: is no long.
SCALE, SHIFT, MOST, TOO_LARGE = 64, 1_000_000, 32, float(1 << 56)
#: Bits of a limb of a component and of a sum, limbs of a sum, rows of a block.
LIMB, SUM_LIMB, SUM_LIMBS, ROWS = 20, 40, 5, 4096
#: Fractional bits of roots and of null spaces; roots nearer to each other than APART bits of their size count as one.
BITS, APART = 384, 200


# Sums over the rows


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """floor(SCALE c) of vectors of dims components, a row each, as long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, dims)


def _exact_products(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers: products of limbs of which doubles hold sums over ROWS rows exactly."""
    limbs, rest = [], y
    while np.abs(rest).max(initial=0) >= 1 << LIMB:
        limbs.append((rest & ((1 << LIMB) - 1)).astype(np.float64))
        rest = rest >> LIMB
    limbs.append(rest.astype(np.float64))
    total = np.zeros((y.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << LIMB * (i + j)
    return total


def _limbs(value: int) -> list[int]:
    out = []
    for _ in range(SUM_LIMBS - 1):
        out.append(value & ((1 << SUM_LIMB) - 1))
        value >>= SUM_LIMB
    return [*out, value]


_SUM = [f"l{k}" for k in range(SUM_LIMBS)]


def _summed(dims: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = _matrix(batch.column(0).slice(at, ROWS), dims)
                n += len(y)
                sums += y.astype(object).sum(axis=0)
                products += _exact_products(y)
        if n:
            found = [(-1, -1, n), *((i, -1, int(s)) for i, s in enumerate(sums)), *((i, j, int(products[i, j])) for i in range(dims) for j in range(i, dims))]
            rows = [(i, j, *_limbs(v)) for i, j, v in found]
            for at in range(0, len(rows), 1 << 14):
                columns = zip(*rows[at : at + (1 << 14)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k > 1 else pa.int32()) for k, c in enumerate(columns)], ["i", "j", *_SUM])

    return scan


def scatter(vectors: DataFrame, dims: int) -> tuple[int, list[int], np.ndarray]:
    """vectors(v): arrays of dims finite doubles. n, the sums of y = floor(SCALE c), and n times the sums of products less the
    products of sums, all exact. A task sends one row for each pair of dimensions."""
    sent = vectors.mapInArrow(_summed(dims), "i int, j int, " + ", ".join(f"{x} long" for x in _SUM))
    rows = sent.groupBy("i", "j").agg(*[F.sum(x).alias(x) for x in _SUM]).collect()
    value = {(r.i, r.j): sum(r[x] << SUM_LIMB * k for k, x in enumerate(_SUM)) for r in rows}
    n = value.get((-1, -1), 0)
    sums = [value.get((i, -1), 0) for i in range(dims)]
    m = np.zeros((dims, dims), object)
    for i in range(dims):
        for j in range(i, dims):
            m[i, j] = m[j, i] = n * value.get((i, j), 0) - sums[i] * sums[j]
    return n, sums, m


# The characteristic polynomial


def primes(count: int) -> list[int]:
    """The largest primes below 2^31."""

    def is_prime(p: int) -> bool:
        d, r = p - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in (2, 3, 5, 7):  # decides below 3.2e9
            x = pow(a, d, p)
            if x in (1, p - 1):
                continue
            for _ in range(r - 1):
                x = x * x % p
                if x == p - 1:
                    break
            else:
                return False
        return True

    out, p = [], (1 << 31) - 1
    while len(out) < count:
        if is_prime(p):
            out.append(p)
        p -= 2
    return out


def polynomial_modulo(m: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(xI - m) modulo p < 2^31, of the lowest power first."""
    h = (m % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[pivot, k + 1]] = h[[k + 1, pivot]]
            h[:, [pivot, k + 1]] = h[:, [k + 1, pivot]]
        f = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - f[:, None] * h[k + 1] % p) % p
        # The same change of basis from the right; products are below 2^62, so they are reduced before they are added.
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2 :] * f % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - h[k - 1, k - 1] * polys[k - 1]) % p
        t = 1
        for i in range(k - 1, 0, -1):
            t = t * int(h[i, i - 1]) % p
            if not t:
                break
            polys[k] = (polys[k] - (t * int(h[i - 1, k - 1]) % p) * polys[i - 1]) % p
    return polys[d]


def polynomial(spark: SparkSession, m: np.ndarray) -> list[int]:
    """Coefficients of det(xI - m), of the lowest power first, for a symmetric m without negative eigenvalues: those of power
    d - k are at most C(d, k) (trace / d)^k, which says how many primes are needed."""
    d, trace = len(m), int(m.trace())
    if not trace:
        return [0] * d + [1]
    most = max(comb(d, k) * (Fraction(trace, d) ** k) for k in range(d + 1))
    found = primes(ceil((log2(most.numerator // most.denominator + 1) + 3) / 30.9) + 1)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([polynomial_modulo(m, p).tolist()])], ["p", "of"])

    tasks = max(1, min(len(found), spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in found], "p long").repartition(tasks)
    rows = dealt.mapInArrow(residues, "p long, of array<long>").collect()
    whole = reduce(int.__mul__, (r.p for r in rows))
    out = [0] * (d + 1)
    for r in rows:
        part = whole // r.p
        part *= pow(part, -1, r.p)
        for k, c in enumerate(r.of):
            out[k] += c * part
    out = [c % whole for c in out]
    return [c - whole if 2 * c > whole else c for c in out]


# Its roots


def _at_scale(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    d = len(poly) - 1
    return [c << bits * (d - k) for k, c in enumerate(poly)]


def count_above(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only lie above `at`: sign changes of its coefficients around it."""
    c = poly[::-1]
    for stop in range(len(c), 1, -1):
        for k in range(1, stop):
            c[k] += at * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _refined(poly: list[int], low: int, high: int) -> int:
    """The one simple root in (low, high], to the nearest whole number or the one beside it."""

    def value(x: int) -> tuple[int, int]:
        v = s = 0
        for c in reversed(poly):
            s = s * x + v
            v = v * x + c
        return v, s

    sign = value(high)[0] > 0 if value(high)[0] else None
    if sign is None:
        return high
    x = (low + high) // 2
    while high - low > 1:
        v, s = value(x)
        if not v:
            return x
        if (v > 0) == sign:
            high = x
        else:
            low = x
        step = x - v // s if s else low
        if abs(step - x) <= 1 and low <= step <= high:
            return step
        x = step if low < step < high else (low + high) // 2
    return high


def roots(poly: list[int], most: int, bits: int = BITS, apart: int = APART) -> list[tuple[int, int]]:
    """The largest positive roots of a monic polynomial with real, not negative roots only, as (2^bits times the root,
    multiplicity), falling, until they are `most` with multiplicity or all. Roots that agree in `apart` bits are one."""
    while len(poly) > 1 and not poly[0]:
        poly = poly[1:]
    d = len(poly) - 1
    if not d:
        return []
    wanted = min(most, d)
    whole, fine = poly, _at_scale(poly, bits)
    top = -poly[-2] + 1  # their sum is an upper bound
    out: list[tuple[int, int]] = []
    # Intervals (low, high] on a grid of whole numbers first, then of 2^-bits; the upper ones are taken first.
    open_ = [(0, top, 0, d, False)]
    while open_ and sum(k for _, k in out) < wanted:
        low, high, above, upto, is_fine = open_.pop()
        if upto == above:
            continue
        if upto - above == 1:
            out.append((_refined(fine, *((low, high) if is_fine else (low << bits, high << bits))), 1))
            continue
        if not is_fine and high - low <= 1:
            low, high, is_fine = low << bits, high << bits, True
        if is_fine and (high - low <= 1 or (high - low) << apart < high):
            out.append(((low + high + 1) // 2, upto - above))
            continue
        middle = (low + high) // 2
        here = count_above(fine if is_fine else whole, middle)
        open_ += [(low, middle, here, upto, is_fine), (middle, high, above, here, is_fine)]
    return out


# Null spaces


def null_vectors(m: np.ndarray, root: int, many: int, bits: int = BITS) -> np.ndarray:
    """`many` orthonormal rows that m takes to root / 2^bits times themselves, to double precision: two rounds of inverse
    iteration in fixed point. The largest component of each row is positive."""
    d = len(m)
    scale = max(0, int(max(abs(x) for x in m.flat)).bit_length())
    a = np.array([[int(x) << bits for x in row] for row in m], object)
    for i in range(d):
        a[i, i] -= root
    a = np.array([[x >> scale for x in row] for row in a], object)  # of size 1 in fixed point
    order, factors = list(range(d)), []
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(a[i, k]))
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
            for f in factors:
                f[k], f[pivot] = f[pivot], f[k]
        if not a[k, k]:
            a[k, k] = 1
        f = np.zeros(d, object)
        for i in range(k + 1, d):
            if a[i, k]:
                f[i] = (a[i, k] << bits) // a[k, k]
                a[i, k:] -= f[i] * a[k, k:] >> bits
        factors.append(f)

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(d):
            if x[k]:
                x[k + 1 :] -= factors[k][k + 1 :] * x[k] >> bits
        for k in range(d - 1, -1, -1):
            x[k] = ((x[k] << bits) - sum(a[k, k + 1 :] * x[k + 1 :])) // a[k, k]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        size = isqrt(sum(x * x)) or 1
        return np.array([(v << bits) // size for v in x], object)

    rng = np.random.default_rng(d)
    found: list[np.ndarray] = []
    for _ in range(many):
        x = np.array([int(v) << bits for v in rng.integers(1, 100, d)], object)
        for _ in range(2):
            x = unit(solved(x))
            for _ in range(2):
                for y in found:
                    x = x - (sum(x * y) * y >> 2 * bits)
                x = unit(x)
        found.append(x if x[max(range(d), key=lambda i: abs(x[i]))] > 0 else -x)
    return np.array([[v / (1 << bits) for v in x] for x in found], np.float64)


# The whitening


@dataclass
class Whitening:
    dims: int
    n: int
    #: Sums of floor(SCALE c), the scatter's eigenvalues (n^2 times the covariance's) times 2^BITS, its trace, unit
    #: eigenvectors as rows, the largest entry of the whitened covariance less the identity.
    sums: list[int]
    values: list[int]
    trace: int
    vectors: np.ndarray
    identity_error: float

    def explained(self) -> list[float]:
        return [float(Fraction(v, self.trace << BITS)) for v in self.values]

    def matrix(self) -> np.ndarray:
        """Takes centred rows to whitened ones."""
        deviations = [sqrt(Fraction(v, self.n * self.n << BITS)) for v in self.values]
        return (self.vectors / np.array(deviations)[:, None]).T if self.values else np.zeros((self.dims, 0))


def _usable(df: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector is neither null nor holds a null, non-finite or too large component, as doubles in v."""
    v = F.col(f"`{vector}`").cast("array<double>")
    return df.where(v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))).withColumn("v", v)


def _dims(vectors: DataFrame) -> int:
    found = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.d if found else 0


def _centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    whole = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([float(Fraction(s % model.n, model.n)) for s in model.sums])
    return (y - whole).astype(np.float64) - rest


def _checked(model: Whitening):
    """Sums of products of whitened components, a row of each task for each pair."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.values)
        a, total = model.matrix(), np.zeros((k + 1, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                w = _centred(_matrix(batch.column(0).slice(at, ROWS), model.dims), model) @ a
                total[:k] += w.T @ w
                total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel().astype(np.int32)) for x in (i, j)] + [pa.array(total.ravel())], ["i", "j", "s"])

    return scan


def fitted(df: DataFrame, vector: str = "embedding", most: int = MOST) -> Whitening:
    """The whitening of df's vectors by up to `most` components, in order of falling eigenvalue. Components without variance,
    whose whitening would divide by zero, are left out."""
    spark, usable = df.sparkSession, _usable(df, vector)
    dims = _dims(usable)
    vectors = usable.where(F.size("v") == dims).select("v")
    n, sums, m = scatter(vectors, dims) if dims else (0, [], np.zeros((0, 0), object))
    trace = int(m.trace()) if dims else 0
    if not trace:
        return Whitening(dims, n, sums, [], 0, np.zeros((0, dims)), 0.0)
    common = gcd(*(int(x) for x in m.flat))
    small = np.array([[int(x) // common for x in row] for row in m], object)
    found = roots(polynomial(spark, small), most)
    first = [sum(k for _, k in found[:i]) for i in range(len(found))]

    def spaces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, root, many in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows = null_vectors(small, int(root), many).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(range(at, at + many), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["at", "row"])

    asked = [(at, str(root), many) for at, (root, many) in zip(first, found, strict=True)]
    tasks = max(1, min(len(asked), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame(asked, "at int, root string, many int").repartition(tasks).mapInArrow(spaces, "at int, row array<double>").collect()
    values = [root * common for root, many in found for _ in range(many)][:most]
    vectors_ = np.array([r.row for r in sorted(rows, key=lambda r: r.at)])[: len(values)]
    model = Whitening(dims, n, sums, values, trace, vectors_, 0.0)
    cells = vectors.mapInArrow(_checked(model), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    k = len(values)
    total = np.zeros((k + 1, k))
    for c in cells:
        total[c.i, c.j] = c.s / n
    model.identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    return model


def _whitened(model: Whitening):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, k = model.matrix(), len(model.values)
        total = np.array(model.sums, object)
        small = max((abs(s) for s in model.sums), default=0) < 1 << 61
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                y = _matrix(part.column(1), model.dims)
                w = np.ascontiguousarray(_centred(y, model) @ a)
                most = int(np.abs(y).max(initial=0)) * model.n
                far = model.n * y - total.astype(np.int64) if small and most < 1 << 61 else model.n * y.astype(object) - total
                if far.dtype != object and int(np.abs(far).max(initial=0)) ** 2 >= (1 << 62) // max(1, model.dims):
                    far = far.astype(object)
                deviation = [x if x < 10**38 else None for x in (far * far).sum(axis=1).tolist()]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviation, pa.decimal128(38)), lists], ["held", "deviation", "whitened"])

    return scan


def whitened(df: DataFrame, model: Whitening, vector: str = "embedding", columns: list[str] | None = None) -> DataFrame:
    """A row of df(vector, any more columns) for each usable vector: df's columns (or those given), deviation (the sum over
    dimensions of (n x - S)^2, exact as decimal(38); null beyond that) and whitened, the array of its whitened components.

    Rows whose vector is null, or holds a null, non-finite or too large component (2^56 and more, whose step is no long),
    and rows whose vector isn't as long as most (of equally many lengths, the largest) take no part; neither do such rows
    in fitted(). Repeated rows and null ids stay as they are. An empty table, or vectors of no component, give no rows; a
    table of equal vectors gives empty arrays. Columns of df called deviation or whitened stay, the new ones get an underscore
    behind their names."""
    columns = df.columns if columns is None else columns
    rows = _usable(df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("held"), F.col(f"`{vector}`").alias("given")), "given")
    rows = rows.where((F.size("v") == model.dims) & F.lit(model.dims > 0)).select("held", "v")
    out = rows.mapInArrow(_whitened(model), f"held {rows.schema['held'].dataType.simpleString()}, deviation decimal(38,0), whitened array<double>")
    names = []
    for name in ("deviation", "whitened"):
        while name in columns or name in names:
            name += "_"
        names.append(name)
    return out.select("held.*", F.col("deviation").alias(names[0]), F.col("whitened").alias(names[1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component; a deviation beyond a long is null."""
    vectors = table(spark, sf_dir, "embeddings")
    model = fitted(vectors)
    explained = F.array(*[F.lit(x) for x in model.explained()]) if model.values else F.array().cast("array<double>")
    rows = whitened(vectors, model, columns=["vec_id"]).select("vec_id", F.expr("try_cast(deviation as bigint)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
