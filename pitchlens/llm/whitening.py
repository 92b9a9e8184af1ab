"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become whole numbers x = floor(1024 c) + 100000, so the scatter matrix n * sum(x x') - S S' is
exact. Its characteristic polynomial is computed modulo many primes (Hessenberg reduction, one task
per group of primes) and put together by Chinese remaindering. All roots are real, so the sign
variations of a shifted polynomial count the roots beyond a point exactly (Descartes' rule); that
isolates the largest roots to any precision. Components come from the null space at a root, by
inverse iteration in decimals of 80 digits or more.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlens.llm.common import table
from pitchlens.staging import stage

#: Entries as whole numbers: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024.0, 100_000
#: Components that are kept, at most.
COMPONENTS = 8
#: Whole numbers are kept between these; floor(1024 c) of larger entries counts as the nearest of them.
LARGEST = 1 << 62
#: Rows that are multiplied at once, and bits of a limb: products of limbs then add up exactly in doubles.
ROWS_AT_ONCE, LIMB_BITS = 2048, 20
#: Sums travel as five digits of so many bits each, which add up in longs over 2^31 tasks.
DIGIT_BITS, DIGITS = 32, 5
#: Bits to which a root is known beyond its leading one.
ROOT_BITS = 200


# Exact sums


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    """floor(1024 c) of each entry, as longs; the offset is added where it matters."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(flat * SCALE), -float(LARGEST), float(LARGEST))
    return scaled.astype(np.int64).reshape(-1, dims)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """y'y in Python's whole numbers; ``y`` is split into limbs whose products are exact in doubles."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), ROWS_AT_ONCE):
        rest = y[start : start + ROWS_AT_ONCE]
        limbs = []
        while rest.any():
            low = ((rest + (1 << (LIMB_BITS - 1))) & ((1 << LIMB_BITS) - 1)) - (1 << (LIMB_BITS - 1))
            limbs.append(low.astype(np.float64))
            rest = (rest - low) >> LIMB_BITS
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
    return total


def digits_of(value: int) -> list[int]:
    """Digits of ``value`` to the base 2^32, each with the sign of ``value``."""
    sign, rest = (-1, -value) if value < 0 else (1, value)
    return [sign * (rest >> (DIGIT_BITS * k) & ((1 << DIGIT_BITS) - 1)) for k in range(DIGITS)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and number of dimensions: rows (i = j = -1), sums (j = -1), sums of products (i <= j)."""
    held: dict[int, tuple] = {}
    for batch in batches:
        widths = batch.column(0).value_lengths().to_numpy()
        for dims in np.unique(widths).tolist():
            y = _whole(batch.column(0).take(pa.array(np.flatnonzero(widths == dims))), dims)
            count, total, gram = held.get(dims, (0, 0, 0))
            safe = int(np.abs(y).max(initial=0)) * len(y) < LARGEST
            own = (y if safe else y.astype(object)).sum(axis=0).astype(object)
            held[dims] = (count + len(y), total + own, gram + exact_gram(y))
    for dims, (count, total, gram) in held.items():
        rows = [(-1, -1, count)] + [(i, -1, int(total[i])) for i in range(dims)]
        rows += [(i, j, int(gram[i, j])) for i in range(dims) for j in range(i, dims)]
        for start in range(0, len(rows), 100_000):
            part = rows[start : start + 100_000]
            numbers = np.array([digits_of(v) for _, _, v in part], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([dims] * len(part), pa.int32()), pa.array([r[0] for r in part], pa.int32()),
                 pa.array([r[1] for r in part], pa.int32()), *(pa.array(numbers[:, k]) for k in range(DIGITS))],
                ["dims", "i", "j", *(f"d{k}" for k in range(DIGITS))],
            )


@dataclass
class Scatter:
    """``n`` vectors, the sums ``total`` of their whole entries x, and n * sum(x x') - S S'."""

    n: int
    total: list[int]
    matrix: list[list[int]]


def scatters(vectors: DataFrame) -> dict[int, Scatter]:
    """The exact scatter of the column ``vec``, by number of dimensions.

    Tasks add up their own rows first; the driver gets dims^2 / 2 numbers, whatever the rows.
    """
    digits = [f"d{k}" for k in range(DIGITS)]
    schema = ", ".join(["dims int, i int, j int", *(f"{d} long" for d in digits)])
    sums = vectors.select("vec").mapInArrow(_sums, schema).groupBy("dims", "i", "j").agg(*(F.sum(d).alias(d) for d in digits))
    found: dict[int, Scatter] = {}
    for row in sums.orderBy("dims", "i", "j").toLocalIterator():
        value = sum(int(row[d]) << (DIGIT_BITS * k) for k, d in enumerate(digits))
        if row.i < 0:
            found[row.dims] = Scatter(value, [0] * row.dims, [[0] * row.dims for _ in range(row.dims)])
        elif row.j < 0:
            found[row.dims].total[row.i] = value
        else:
            found[row.dims].matrix[row.i][row.j] = value
    for scatter in found.values():
        s, m = scatter.total, scatter.matrix
        for i in range(len(s)):  # the offset does not change the scatter
            for j in range(i, len(s)):
                m[i][j] = m[j][i] = scatter.n * m[i][j] - s[i] * s[j]
        scatter.total = [v + OFFSET * scatter.n for v in s]
    return found


# The characteristic polynomial


def _is_prime(n: int) -> bool:
    """Miller's test with bases that are enough below 3.2 * 10^9."""
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes below 2^31, the largest first, whose product has more than ``bits`` bits."""
    found, candidate, product = [], (1 << 31) - 1, 1
    while product.bit_length() <= bits:
        if _is_prime(candidate):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def hessenberg_polynomial(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p`` < 2^31, that of x^0 first.

    Similarity transforms make the matrix upper Hessenberg; the polynomials of its leading blocks
    then follow from one another.
    """
    h = matrix % p
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2 :, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - factors[:, None] * h[k + 1] % p) % p
        for row, factor in zip(range(k + 2, d), factors.tolist()):
            if factor:
                h[:, k + 1] = (h[:, k + 1] + factor * h[:, row]) % p
    polynomials = np.zeros((d + 1, d + 1), np.int64)
    polynomials[0, 0] = 1
    for k in range(d):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polynomials[k, :-1]
        new = (new - h[k, k] * polynomials[k] % p) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            new = (new - int(h[i, k]) * below % p * polynomials[i] % p) % p
        polynomials[k + 1] = new
    return polynomials[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of det(x - matrix), that of x^0 first, for a positive semidefinite matrix.

    Each task reduces modulo its primes. The coefficient of x^(d-k) is the k-th elementary symmetric
    sum of the roots, at most binomial(d, k) * (trace / d)^k, which says how many primes are needed.
    """
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    most = max(math.comb(d, k) * (trace // d + 1) ** k for k in range(d + 1))
    primes = primes_for(most.bit_length() + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(matrix, object)
        for batch in batches:
            chosen = [primes[i] for i in batch.column(0).to_pylist()]
            found = [hessenberg_polynomial((whole % p).astype(np.int64), p).tolist() for p in chosen]
            yield pa.RecordBatch.from_arrays([pa.array(chosen), pa.array(found)], ["p", "coefficients"])

    tasks = max(1, min(len(primes), spark.sparkContext.defaultParallelism))
    rows = spark.range(0, len(primes), 1, tasks).mapInArrow(run, "p long, coefficients array<long>").collect()
    return chinese_remainder({row.p: row.coefficients for row in rows})


def chinese_remainder(residues: dict[int, list[int]]) -> list[int]:
    """The numbers of smallest size with the given residues for each prime."""
    product = math.prod(residues)
    total = [0] * len(next(iter(residues.values())))
    for p, values in residues.items():
        others = product // p
        weight = others * pow(others, -1, p)
        total = [t + weight * v for t, v in zip(total, values)]
    total = [t % product for t in total]
    return [t - product if t > product // 2 else t for t in total]


# Roots


def roots_above(polynomial: list[int], at: int, shift: int) -> int:
    """How many roots of a polynomial with only real ones are larger than at / 2^shift.

    Horner's scheme moves the origin there; the sign variations of the coefficients are the number of
    positive roots, exactly, because all roots are real.
    """
    d = len(polynomial) - 1
    moved = [c << (shift * (d - k)) for k, c in enumerate(polynomial)]
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            moved[k] += at * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(polynomial: list[int], at: int, shift: int) -> int:
    """The sign of the polynomial at at / 2^shift."""
    value, power = 0, 1
    for c in reversed(polynomial):
        value = value * at + c * power
        power <<= shift
    return (value > 0) - (value < 0)


@dataclass(frozen=True)
class Root:
    """A root in (low / 2^shift, (low + width) / 2^shift], with its number of components."""

    low: int
    width: int
    shift: int
    times: int

    def middle(self) -> tuple[int, int]:
        return 2 * self.low + self.width, self.shift + 1


def largest_roots(polynomial: list[int], most: int = COMPONENTS, bits: int = ROOT_BITS) -> list[Root]:
    """The largest positive roots, falling, until they are ``most`` with multiplicity, to ``bits`` bits.

    Roots that agree to so many bits are one root of several components.
    """
    trace = -polynomial[-2]
    positive = roots_above(polynomial, 0, 0)
    found: list[Root] = []
    counted = 0
    while counted < min(most, positive):
        low, width, shift, above_high = 0, 1 << max(1, trace.bit_length()), 0, 0
        single = False
        while True:
            # Halve (low, low + width], keep the half of root number counted + 1.
            if width == 1:
                low, width, shift = 2 * low, 2, shift + 1
            half = low + width // 2
            if single:
                beyond = above_high + (sign_at(polynomial, half, shift) * top_sign < 0)
            else:
                beyond = roots_above(polynomial, half, shift)
            if beyond > counted:
                low, width = half, width - width // 2
                count_low = beyond
            else:
                above_high, width = beyond, width // 2
                count_low = None
            if not single:
                count_low = roots_above(polynomial, low, shift) if count_low is None else count_low
                if count_low - above_high == 1 and sign_at(polynomial, low + width, shift):
                    # One root within: its side follows from the sign alone.
                    single, top_sign = True, sign_at(polynomial, low + width, shift)
                times = count_low - above_high
            if low and low.bit_length() - width.bit_length() >= bits:
                break
        found.append(Root(low, width, shift, times))
        counted = above_high + times
    return found


# Components


def null_space(matrix: list[list[int]], root: Root) -> list[list[decimal.Decimal]]:
    """Orthonormal eigenvectors at a root: inverse iteration with the matrix less the root.

    Gaussian elimination with pivots, in decimals; a pivot of zero counts as the smallest number that
    matters. Starting vectors are fixed, so every run gives the same components.
    """
    d = len(matrix)
    at, shift = root.middle()
    size = max(1, max(abs(matrix[i][i]) for i in range(d)))
    with decimal.localcontext() as context:
        # The largest entry cancels against the root: its digits, and those that the root is known to.
        context.prec = 40 + len(str(size)) + math.ceil(ROOT_BITS * 0.302)
        value = decimal.Decimal(at) / (decimal.Decimal(2) ** shift)
        tiny = decimal.Decimal(size) * decimal.Decimal(10) ** -(context.prec - 5)
        rows = [[decimal.Decimal(v) for v in line] for line in matrix]
        for i in range(d):
            rows[i][i] -= value
        order = list(range(d))
        for k in range(d):
            best = max(range(k, d), key=lambda i: abs(rows[i][k]))
            rows[k], rows[best] = rows[best], rows[k]
            order[k], order[best] = order[best], order[k]
            if abs(rows[k][k]) < tiny:
                rows[k][k] = tiny
            pivot = rows[k]
            for i in range(k + 1, d):
                line = rows[i]
                if line[k]:
                    factor = line[k] / pivot[k]
                    line[k] = factor
                    for j in range(k + 1, d):
                        if pivot[j]:
                            line[j] -= factor * pivot[j]

        def solve(right: list[decimal.Decimal]) -> list[decimal.Decimal]:
            out = [right[i] for i in order]
            for i in range(d):
                line = rows[i]
                out[i] -= sum((line[j] * out[j] for j in range(i)), decimal.Decimal(0))
            for i in range(d - 1, -1, -1):
                line = rows[i]
                out[i] = (out[i] - sum((line[j] * out[j] for j in range(i + 1, d)), decimal.Decimal(0))) / line[i]
            return out

        found: list[list[decimal.Decimal]] = []

        def normal(vector: list[decimal.Decimal]) -> list[decimal.Decimal]:
            for _ in range(2):
                for other in found:
                    along = sum((a * b for a, b in zip(vector, other)), decimal.Decimal(0))
                    vector = [a - along * b for a, b in zip(vector, other)]
            length = sum((a * a for a in vector), decimal.Decimal(0)).sqrt()
            return [a / length for a in vector]

        rng = np.random.default_rng(12)
        for _ in range(root.times):
            vector = normal([decimal.Decimal(int(v)) for v in rng.integers(1, 1 << 20, d)])
            for _ in range(3):
                vector = normal(solve(vector))
            found.append(vector)
        return found


@dataclass
class Whitening:
    """Components (rows of ``vectors``), their variances and their shares of the whole variance."""

    n: int
    total: list[int]
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    variances: np.ndarray = field(default_factory=lambda: np.zeros(0))
    explained: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def apply(self, y: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Deviation of each row, exact, and its whitened values; ``y`` lacks the offset."""
        total = [t - OFFSET * self.n for t in self.total]
        largest = max([1, *map(abs, total)]) + self.n * int(np.abs(y).max(initial=0))
        if largest * largest * y.shape[1] < 1 << 62:
            centred = self.n * y - np.array(total, np.int64)
            deviation = (centred * centred).sum(axis=1).tolist()
        else:
            centred = self.n * y.astype(object) - np.array(total, object)
            deviation = [int(v) for v in (centred * centred).sum(axis=1)]
        floats = (centred / self.n).astype(np.float64)
        return deviation, floats @ self.vectors.T / np.sqrt(self.variances)


def fit(spark: SparkSession, scatter: Scatter, components: int = COMPONENTS) -> Whitening:
    """Components of a scatter, by falling variance; the largest entry of each is positive.

    There are as many as the rank if that is less than ``components``, and none for a single vector or
    equal ones. If roots agree to ``ROOT_BITS`` bits, their components are some orthonormal basis.
    """
    d, n, matrix = len(scatter.total), scatter.n, scatter.matrix
    trace = sum(matrix[i][i] for i in range(d))
    if not trace:
        return Whitening(n, scatter.total, np.zeros((0, d)))
    roots = largest_roots(characteristic_polynomial(spark, matrix), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                basis = [[float(v) for v in vector] for vector in null_space(matrix, roots[i])]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(basis)), pa.array(basis)], ["root", "vector"])

    jobs = spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "root long, vector array<double>")
    vectors, variances, explained = [], [], []
    for row in sorted(jobs.collect(), key=lambda r: r.root):
        at, shift = roots[row.root].middle()
        vector = np.array(row.vector)
        vectors.append(vector if vector[np.abs(vector).argmax()] > 0 else -vector)
        variances.append(at / (n * n << shift))
        explained.append(at / (trace << shift))
    keep = slice(0, components)
    return Whitening(n, scatter.total, np.array(vectors)[keep], np.array(variances)[keep], np.array(explained)[keep])


# Rows


def _apply(models: dict[int, Whitening]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column(1).value_lengths().to_numpy()
            for dims in np.unique(widths).tolist():
                part = batch.take(pa.array(np.flatnonzero(widths == dims)))
                deviation, values = models[dims].apply(_whole(part.column(1), dims))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([dims] * part.num_rows, pa.int32()),
                     pa.array([str(v) for v in deviation]), pa.array(values.tolist(), pa.list_(pa.float64()))],
                    ["vec_id", "dims", "deviation", "whitened"],
                )

    return run


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """Whitened values of every usable vector along the largest components.

    Returns a row per row and component: ``vec_id``, ``component`` (from 1, by falling variance), ``n``,
    ``deviation`` (squared distance from the mean times n^2, exact), ``whitened``, ``explained`` (share
    of the variance), ``identity_error`` (largest entry of the whitened covariance less the
    identity), ``deviation_exact`` (the same as a decimal; beyond a long, ``deviation`` is null).
    Vectors that are null or empty or hold null or non-finite entries are dropped; vectors of different
    length are whitened apart. Rows without id and repeated rows count and are returned like others.
    Entries beyond 2^62 / 1024 count as that. If the vectors are all equal, or there is one only or
    none, nothing varies: there are no components and no rows. Further columns are not read.
    """
    spark = vectors.sparkSession
    kind = vectors.schema[vec_col].dataType.simpleString()
    vec = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = rows.filter((F.size("vec") > 0) & F.coalesce(finite, F.lit(False)))
    models = {dims: fit(spark, scatter, components) for dims, scatter in scatters(rows).items()}
    told = "vec_id long, dims int, deviation string, whitened array<double>"
    done = stage(rows.mapInArrow(_apply(models), told), "whitened")
    errors = []
    for dims, model in models.items():
        kept = len(model.variances)
        own = done.filter(F.col("dims") == dims)
        value = [F.element_at("whitened", i + 1) for i in range(kept)]
        pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
        if pairs:  # covar_pop centres before it multiplies
            found = own.agg(*(F.covar_pop(value[i], value[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
            worst = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
            errors += [(dims, i + 1, model.n, float(model.explained[i]), float(worst)) for i in range(kept)]
    about = "dims int, component int, n long, explained double, identity_error double"
    known = F.broadcast(spark.createDataFrame(errors, about))  # a row per width and component
    out = done.select("vec_id", "dims", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    out = out.withColumn("component", F.col("_at") + 1).join(known, ["dims", "component"])
    return out.select(
        "vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained",
        "identity_error", F.col("deviation").try_cast("decimal(38,0)").alias("deviation_exact"),
    )


def whitening_query(spark, folder: str) -> DataFrame:
    """op12: all rows of ``embeddings``."""
    return whiten(table(spark, folder, "embeddings"))
