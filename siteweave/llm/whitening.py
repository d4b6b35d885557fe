"""Operator 11: whitening of embeddings through the exact characteristic polynomial.

Entries become whole numbers, so the scatter matrix M = n * sum(x x') - S S' (n squared
times the covariance) is exact. Its characteristic polynomial is found modulo many primes,
one reduction to Hessenberg form each, spread over the tasks, and put together by Chinese
remaindering. All its roots are real, so the number above any point is the number of sign
changes of the shifted polynomial: roots are isolated exactly and halved down to some 200
bits. Each task then solves for the null space of M - root * I by inverse iteration in
fixed-point numbers of 400 bits; roots that are equal get orthogonal vectors.

Only tables whose size the vector width fixes (sums, residues, roots, vectors) reach the
driver. Vectors are read three times and never shuffled.

Cases: rows whose vector is null, empty or holds null or non-finite entries take no part,
nor do rows of another width than that of most (ties: the larger). floor(64 * c) beyond
2**62 in size counts as 2**62. Null and repeated vec_ids and repeated rows are rows like
others. Components are given for positive eigenvalues only: none for one row or for equal
rows, fewer than the width where dimensions depend on each other. ``deviation`` is null
where it does not fit a long. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, MOST = 64, 1 << 62
LIMB = 60  # bits of a sum that one decimal cell holds
ROOT_BITS, FIXED_BITS = 200, 400
BLOCK = 1024  # rows whose products are summed at once
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- whole numbers and their sums


def whole_entries(values: pa.Array, width: int) -> np.ndarray:
    """The rows of a list array of ``width`` doubles each as whole numbers."""
    flat = np.floor(values.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) * SCALE)
    out = np.where(np.abs(flat) < MOST, flat, 0).astype(np.int64)
    return np.where(flat >= MOST, MOST, np.where(flat <= -MOST, -MOST, out)).reshape(-1, width)


def _exact_gram(x: np.ndarray) -> np.ndarray:
    """sum(x x') of up to ``BLOCK`` rows, exactly: limbs of 21 bits keep every product and sum inside a double."""
    limbs, rest = [], x
    while np.abs(rest).max(initial=0) >= 1 << 20:
        limbs.append((rest & 0x1FFFFF).astype(np.float64))
        rest = rest >> 21
    limbs.append(rest.astype(np.float64))
    out = np.zeros((x.shape[1],) * 2, object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out = out + (a.T @ b).astype(np.int64).astype(object) * (1 << 21 * (i + j))
    return out


def _cells(value: int) -> list[tuple[int, int]]:
    """A whole number in limbs, the last with the sign."""
    out, limb = [], 0
    while not -(1 << 100) < value < (1 << 100):
        value, low = value >> LIMB, value & ((1 << LIMB) - 1)
        out.append((limb, low))
        limb += 1
    return [*out, (limb, value)]


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums of all dimensions and the sums of all products, whatever their size."""
    at = [(i, j) for i in range(width) for j in range(i, width)]

    def run(batches):
        n, sums, gram = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                x = whole_entries(batch.column(1).slice(lo, BLOCK), width)
                n += len(x)
                sums = sums + (x.astype(object).sum(axis=0) if np.abs(x).max() >= 1 << 50 else x.sum(axis=0).astype(object))
                gram = gram + _exact_gram(x)
        if n:
            values = [n, *sums, *(gram[i, j] for i, j in at)]
            found = [(cell, limb, part) for cell, value in enumerate(values) for limb, part in _cells(int(value))]
            cells, limbs, parts = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(limbs, pa.int32()), pa.array(list(map(str, parts)))], ["cell", "limb", "part"])

    parts = rows.mapInArrow(run, "cell int, limb int, part string")
    totals = parts.groupBy("cell", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    values = [0] * (1 + width + len(at))
    for cell, limb, part in totals:
        values[cell] += int(part) << (LIMB * limb)
    gram = [[0] * width for _ in range(width)]
    for (i, j), value in zip(at, values[1 + width :], strict=True):
        gram[i][j] = gram[j][i] = value
    return values[0], values[1 : 1 + width], gram


# --- the characteristic polynomial


def primes(width: int, bits: int) -> list[int]:
    """The largest primes whose products can be summed ``width`` times in 63 bits, as many as hold ``bits``."""
    p, out, held = isqrt((1 << 62) // max(1, width)) | 1, [], 0
    while held < bits:
        p -= 2
        if pow(2, p - 1, p) == 1 and all(p % q for q in range(3, isqrt(p) + 1, 2)):
            out.append(p)
            held += p.bit_length() - 1
    return out


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """det(x I - matrix) modulo p, constant term first, by reduction to Hessenberg form."""
    h, d = matrix % p, len(matrix)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + below[0]
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factor = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factor[:, None] * h[k + 1] % p) % p
        h[:, k + 1] = (h[:, k + 1] + h[:, k + 2 :] @ factor) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(d):
        new = -h[k, k] * polys[k] % p
        new[1:] = (new[1:] + polys[k, :-1]) % p
        chain, weights = 1, np.zeros(k, np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            weights[i] = chain * int(h[i, k]) % p
        polys[k + 1] = (new - weights @ polys[:k]) % p
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Constant term first. The matrix has no negative eigenvalue, which bounds every coefficient."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    modules = primes(d, bound.bit_length() + 2)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [polynomial_mod(np.array([[v % p for v in row] for row in matrix], np.int64), int(p)).tolist() for p in pdf["p"]]
            yield pd.DataFrame({"p": pdf["p"], "coefficients": found})

    tasks = max(1, min(len(modules), spark.sparkContext.defaultParallelism))
    rows = spark.createDataFrame([(p,) for p in modules], "p long").repartition(tasks).mapInPandas(run, "p long, coefficients array<long>").collect()
    product = 1
    for p, _ in rows:
        product *= p
    out = [0] * (d + 1)
    for p, coefficients in rows:
        part = product // p
        part *= pow(part, -1, p)
        for k, c in enumerate(coefficients):
            out[k] += c * part
    return [(c + product // 2) % product - product // 2 for c in out]


# --- roots


def roots_above(poly: list[int], at: int) -> int:
    """How many of the (all real) roots lie above ``at``: sign changes of the polynomial moved there."""
    c = list(poly)
    for k in range(len(c) - 1):
        for j in range(len(c) - 2, k - 1, -1):
            c[j] += at * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def value_sign(poly: list[int], at: int) -> int:
    out = 0
    for c in reversed(poly):
        out = out * at + c
    return (out > 0) - (out < 0)


def scaled_polynomial(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are ``2**bits`` times as large."""
    d = len(poly) - 1
    return [c << bits * (d - k) for k, c in enumerate(poly)]


def isolated_roots(poly: list[int], most: int, hints: list[float]) -> tuple[int, list[tuple[int, int, int]]]:
    """Scale bits, and intervals (low, high] of the ``most`` largest positive roots with their number, falling.

    The hints only choose where to split first; every count is exact. An interval with more
    than one root is one unit wide: its roots are equal to ``ROOT_BITS`` bits.
    """
    zeros = next((k for k, c in enumerate(poly) if c), len(poly) - 1)
    poly = poly[zeros:]
    d = len(poly) - 1
    if not d:
        return 0, []
    top = -poly[-2]  # the sum of the roots
    least = max(1, abs(poly[0]) // max(1, top ** (d - 1)))  # no positive root is smaller
    bits = max(0, ROOT_BITS - least.bit_length()) if d <= most else max(0, ROOT_BITS - (top // (d * d) + 1).bit_length())
    scaled = scaled_polynomial(poly, bits)
    marks = sorted({int(Fraction(a + b) / 2 * (1 << bits)) for a, b in zip(hints, hints[1:], strict=False) if a > 0 and b > 0})
    above = {0: d, top << bits: 0}
    for mark in reversed(marks):  # from the largest down, until enough roots are above
        if 0 < mark < top << bits:
            above[mark] = roots_above(scaled, mark)
            if above[mark] >= most:
                break
    edges = sorted(above)
    todo, found, have = [(a, b, above[a], above[b]) for a, b in zip(edges, edges[1:], strict=False)], [], 0
    while todo and have < most:
        low, high, n_low, n_high = todo.pop()
        if n_low == n_high:
            continue
        if n_low - n_high == 1 or high - low == 1:
            found.append((low, high, n_low - n_high))
            have += n_low - n_high
            continue
        mid = (low + high) // 2
        n_mid = roots_above(scaled, mid)
        todo += [(low, mid, n_low, n_mid), (mid, high, n_mid, n_high)]
    return bits, found


def refined_root(scaled: list[int], low: int, high: int, count: int) -> int:
    """The upper end of the unit interval with the root."""
    if count > 1:
        return high
    sign = value_sign(scaled, high)
    if not sign:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        s = value_sign(scaled, mid)
        if not s:
            return mid
        low, high = (low, mid) if s == sign else (mid, high)
    return high


# --- vectors


def null_vectors(matrix: list[list[int]], root: int, bits: int, count: int) -> list[list[float]]:
    """Unit vectors of the ``count``-fold eigenvalue ``root / 2**bits``, by inverse iteration in fixed-point numbers."""
    d, unit = len(matrix), FIXED_BITS
    size = max(1, max(abs(v) for row in matrix for v in row)).bit_length()
    rows = np.array([[(v << unit) >> size for v in row] for row in matrix], object)
    lam = (root << unit) >> (bits + size)
    for i in range(d):
        rows[i, i] -= lam
    order, factors = list(range(d)), np.zeros((d, d), object)
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(rows[i, k]))
        rows[[k, pivot]], factors[[k, pivot]] = rows[[pivot, k]], factors[[pivot, k]]
        order[k], order[pivot] = order[pivot], order[k]
        if not rows[k, k]:
            rows[k, k] = 1
        for i in range(k + 1, d):
            if rows[i, k]:
                f = factors[i, k] = (rows[i, k] << unit) // rows[k, k]
                rows[i, k:] -= (f * rows[k, k:]) >> unit

    def solved(b):
        y = [b[i] for i in order]
        for i in range(d):
            y[i] -= int(np.dot(factors[i, :i], np.array(y[:i], object))) >> unit if i else 0
        for i in range(d - 1, -1, -1):
            rest = int(np.dot(rows[i, i + 1 :], np.array(y[i + 1 :], object))) >> unit if i + 1 < d else 0
            y[i] = ((y[i] - rest) << unit) // rows[i, i]
        return y

    def unit_length(v):
        big = max(map(abs, v)) or 1
        v = [(x << 2 * unit) // big for x in v]
        length = isqrt(sum(x * x for x in v)) or 1
        return [(x << unit) // length for x in v]

    found: list[list[int]] = []
    for m in range(count):
        v = unit_length([(((i * 2654435761 + (m + 1) * 40503 + i * i * m) % 1009) - 504 or 1) << unit for i in range(d)])
        for _ in range(3):
            v = unit_length(solved(v))
            for u in found:
                along = sum(a * b for a, b in zip(u, v, strict=True)) >> unit
                v = [b - (along * a >> unit) for a, b in zip(u, v, strict=True)]
            v = unit_length(v)
        found.append(v)
    return [[float(Fraction(x, 1 << unit)) for x in v] for v in found]


def principal_components(spark: SparkSession, matrix: list[list[int]], most: int) -> list[tuple[Fraction, list[float]]]:
    """The ``most`` largest positive eigenvalues of a whole, positive semidefinite matrix with unit vectors, falling."""
    if not any(matrix[i][i] for i in range(len(matrix))):
        return []
    size = max(0, max(v for row in matrix for v in row).bit_length() - 900)
    hints = np.linalg.eigvalsh(np.array([[float(v >> size) for v in row] for row in matrix])) * 2.0**size
    poly = characteristic_polynomial(spark, matrix)
    bits, found = isolated_roots(poly, most, hints.tolist())
    scaled = scaled_polynomial(poly[next(k for k, c in enumerate(poly) if c) :], bits)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                root = refined_root(scaled, int(row.low), int(row.high), int(row.count))
                yield pd.DataFrame({"at": [row.at], "root": [str(root)], "vectors": [null_vectors(matrix, root, bits, int(row.count))]})

    intervals = [(k, str(low), str(high), count) for k, (low, high, count) in enumerate(found)]
    tasks = max(1, min(len(intervals), 2 * spark.sparkContext.defaultParallelism))
    table = spark.createDataFrame(intervals, "at int, low string, high string, `count` int").repartition(tasks, "at")
    rows = sorted(table.mapInPandas(run, "at int, root string, vectors array<array<double>>").collect())
    return [(Fraction(int(root), 1 << bits), list(v)) for _, root, vectors in rows for v in vectors][:most]


# --- the operator


class Whitening:
    """What the fit list gives: n, sums, components, and the projection of whole-number rows."""

    def __init__(self, n: int, sums: list[int], gram: list[list[int]], components: list[tuple[Fraction, list[float]]]):
        self.n, self.sums = n, sums
        trace = sum(n * gram[i][i] - sums[i] * sums[i] for i in range(len(sums)))
        self.eigenvalues = [float(root / n**2) for root, _ in components]
        self.explained = [float(root / trace) for root, _ in components]
        # (x - S / n) . v / sqrt(e) is (n x - S) . v / sqrt(root)
        self.directions = np.array([np.array(v) / _sqrt(root) for root, v in components]).T

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: 64-bit whole numbers where they suffice."""
        if max(self.n * int(np.abs(x).max(initial=0)), *map(abs, self.sums), 0) < 1 << 61:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def deviation(self, z: np.ndarray) -> list[int | None]:
        if z.dtype != object and np.abs(z).max(initial=0) ** 2 < (1 << 62) // max(1, z.shape[1]) and np.abs(z).max(initial=0) < 1 << 31:
            return (z * z).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in z]
        return [v if v < 1 << 63 else None for v in exact]

    def whitened(self, z: np.ndarray) -> np.ndarray:
        return z.astype(np.float64) @ self.directions


def _sqrt(root: Fraction) -> float:
    """The square root of a positive fraction of any size, to double precision."""
    shift = max(0, 120 - root.numerator.bit_length() + root.denominator.bit_length())
    shift += shift % 2
    return float(Fraction(isqrt((root.numerator << shift) // root.denominator), 1 << shift // 2))


def usable_vectors(rows: DataFrame) -> DataFrame:
    """``rows(vec_id, embedding)`` without null, empty, partly null or non-finite vectors, in doubles."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    doubles = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return doubles.where(F.coalesce((F.size("embedding") > 0) & finite, F.lit(False)))


def fit_whitening(vectors: DataFrame, most: int = 32) -> tuple[Whitening | None, DataFrame]:
    """The whitening of ``usable_vectors``, and those of the common width."""
    spark = vectors.sparkSession
    widths = vectors.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    if not widths:
        return None, vectors
    width = widths[0].width
    vectors = vectors.where(F.size("embedding") == width)
    n, sums, gram = exact_sums(vectors, width)
    matrix = [[n * gram[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    components = principal_components(spark, matrix, most)
    return (Whitening(n, sums, gram, components) if components else None), vectors


def identity_error(fit: Whitening, vectors: DataFrame) -> float:
    """The largest entry of the whitened rows' covariance minus the identity."""
    k, width = len(fit.eigenvalues), len(fit.sums)

    def run(batches):
        sums, gram = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fit.whitened(fit.centred(whole_entries(batch.column(1), width)))
            sums += w.sum(axis=0)
            gram += w.T @ w
        values = np.concatenate([sums, gram.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["cell", "part"])

    rows = vectors.mapInArrow(run, "cell int, part double").groupBy("cell").agg(F.sum("part").alias("part")).collect()
    values = np.zeros(k + k * k)
    for cell, part in rows:
        values[cell] = part
    mean = values[:k] / fit.n
    return float(np.abs(values[k:].reshape(k, k) / fit.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, fit: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened array<double>`` of every row."""
    width = len(fit.sums)

    def run(batches):
        for batch in batches:
            z = fit.centred(whole_entries(batch.column(1), width))
            w = fit.whitened(z)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fit.deviation(z), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit, vectors = fit_whitening(usable_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    if fit is None:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(fit, vectors)
    shares = F.array(*map(F.lit, fit.explained))
    rows = whiten(vectors, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
