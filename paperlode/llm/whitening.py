"""Whitening of vectors by principal components.

Entries become whole numbers, x = floor(64 * c) + 1000000, so that counts, sums and centred products can be exact.

1. Counts and sums S of all remaining vectors, one small row per task, added by Spark.
2. Covariance V, divisor n: every task centres its vectors by the whole number next to the mean and adds up products of
   the centred numbers (whole numbers, exact in doubles below 2^53); Spark adds the tasks' matrices row by row. The rest
   of the mean, below one half, is taken out in whole numbers, so V is right to one rounding and does not depend on
   partitions.
3. On the driver, for a d x d matrix only: Householder reflections make V tridiagonal; Sturm counts and bisection give the
   leading eigenvalues; inverse iteration gives their vectors, reorthogonalised inside clusters of close eigenvalues;
   the reflections carry them back.
4. The d x k projection goes to the tasks by broadcast; its size is that of the vectors, not of the table.

What comes to the driver: d sums, d rows of V, k rows of the covariance of whitened vectors.

Cases: a vector that is null or empty, or that holds null, NaN or infinite entries, is left out; so is one whose
length is not the most common one (ties: the longest). Entries beyond 2^46 are cut to that, where whole numbers are still
exact. Null ids are carried through and repeated rows count each. Directions without variance (eigenvalue at most
d * 2^-50 of the largest) have no component, so a table of equal vectors or of one vector gives no rows, as does an
empty one. Other columns of the input are ignored.
"""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 64, 1_000_000
MAX_COMPONENTS = 32
#: Largest size of an entry times ``SCALE``.
CUT = float(1 << 52)
#: Numbers are added in two parts, so that sums of a task stay below 2^63.
_LOW = 26
#: Eigenvalues closer than this share of the norm are one cluster.
_CLUSTER = 1e-3


# --- eigenvectors of a small symmetric matrix -----------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Diagonal, off-diagonal and the reflections that made them: each (column, unit vector or None)."""
    a = np.array(a, dtype=np.float64)
    n, mirrors = len(a), []
    for k in range(n - 2):
        x = a[k + 1:, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            mirrors.append((k, None))
            continue
        x[0] += size if x[0] >= 0 else -size
        u = x / np.linalg.norm(x)
        rest = a[k + 1:, k + 1:]
        p = rest @ u
        q = p - (u @ p) * u
        rest -= 2 * (np.outer(u, q) + np.outer(q, u))
        column = a[k + 1:, k] - 2 * u * (u @ a[k + 1:, k])
        a[k + 1:, k] = a[k, k + 1:] = column
        mirrors.append((k, u))
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: for each x, the number of eigenvalues less than it."""
    count = np.zeros(len(x), dtype=np.int64)
    q = np.ones(len(x))
    for k in range(len(diagonal)):
        q = diagonal[k] - x - (off[k - 1] ** 2 / q if k else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, by bisection on Sturm counts."""
    n = len(diagonal)
    edge = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    least, most = float((diagonal - edge).min()), float((diagonal + edge).max())
    norm = max(abs(least), abs(most), np.finfo(float).tiny)
    tiny = np.finfo(float).eps ** 2 * norm
    rank = n - np.arange(k)  # the r-th smallest
    low, high = np.full(k, least - 1e-15 * norm), np.full(k, most + 1e-15 * norm)
    for _ in range(200):
        middle = (low + high) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        reached = below(diagonal, off, middle, tiny) >= rank
        high = np.where(reached, middle, high)
        low = np.where(reached, low, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, off: np.ndarray, shift: float, tiny: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solver of (T - shift) z = b by elimination with row exchanges; a zero pivot becomes ``tiny``."""
    n = len(diagonal)
    d, u = diagonal - shift, np.append(off, 0.0)
    rows = []  # (pivot, next, next but one), multiplier, exchanged
    here = (float(d[0]), float(u[0]), 0.0)
    for k in range(n - 1):
        under = (float(off[k]), float(d[k + 1]), float(u[k + 1]))
        swap = abs(under[0]) > abs(here[0])
        top, low = (under, here) if swap else (here, under)
        pivot = top[0] if abs(top[0]) > tiny else tiny
        m = low[0] / pivot
        rows.append(((pivot, top[1], top[2]), m, swap))
        here = (low[1] - m * top[1], low[2] - m * top[2], 0.0)
    rows.append(((here[0] if abs(here[0]) > tiny else tiny, 0.0, 0.0), 0.0, False))

    def solve(b: np.ndarray) -> np.ndarray:
        z = [float(x) for x in b] + [0.0, 0.0]
        for k in range(n - 1):
            _, m, swap = rows[k]
            if swap:
                z[k], z[k + 1] = z[k + 1], z[k]
            z[k + 1] -= m * z[k]
        for k in range(n - 1, -1, -1):
            pivot, one, two = rows[k][0]
            z[k] = (z[k] - one * z[k + 1] - two * z[k + 2]) / pivot
            if abs(z[k]) > 1e200:
                z = [x * 1e-200 for x in z]
        return np.array(z[:n])

    return solve


def eigenvectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit vectors of a tridiagonal matrix for falling eigenvalues, as columns: inverse iteration.

    Vectors of a cluster are made orthogonal to the earlier ones of it after every step. Equal eigenvalues get
    shifts a few roundings apart and different starts.
    """
    n, eps = len(diagonal), np.finfo(float).eps
    norm = max(float(np.abs(diagonal).max(initial=0)), float(np.abs(off).max(initial=0)), np.finfo(float).tiny)
    rng = np.random.default_rng(20)
    out = np.zeros((n, len(values)))
    first, shift = 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > _CLUSTER * norm:
            first = k
        shift = min(value, shift - 10 * eps * norm) if k > first else value
        solve = _solve(diagonal, off, shift, eps * norm)
        z = rng.uniform(-1, 1, n)
        for _ in range(6):
            z = solve(z)
            z /= np.abs(z).max()
            near = out[:, first:k]
            for _ in range(2):
                z = z - near @ (near.T @ z)
            size = np.linalg.norm(z)
            z = z / size if size > 1e-8 else rng.uniform(-1, 1, n)
        out[:, k] = z / np.linalg.norm(z)
    return out


def principal(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, largest entry positive."""
    size = float(np.abs(v).max(initial=0))
    if size == 0:
        return np.zeros(0), np.zeros((len(v), 0))
    diagonal, off, mirrors = tridiagonal(v / size)
    values = leading_eigenvalues(diagonal, off, min(k, len(v)))
    values = values[values > len(v) * 2.0 ** -50 * values[0]]
    vectors = eigenvectors(diagonal, off, values)
    for column, u in reversed(mirrors):
        if u is not None:
            vectors[column + 1:] -= 2 * np.outer(u, u @ vectors[column + 1:])
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values * size, vectors


# --- distributed sums -----------------------------------------------------------------------------


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the remaining vectors as whole numbers."""
    c = F.col(vector_col).cast("array<double>")
    fit = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    cut = lambda v: F.greatest(F.least(F.lit(float(SCALE)) * v, F.lit(CUT)), F.lit(-CUT))
    x = F.transform("c", lambda v: F.floor(cut(v)).cast("bigint") + F.lit(SHIFT).cast("bigint"))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.when(fit & (F.size(c) > 0), c).alias("c"))
    return rows.filter("c is not null").select("vec_id", x.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of d whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Sums:
    """Number of fitted vectors and their exact sums per dimension."""

    n: int
    s: tuple[int, ...]

    @property
    def middle(self) -> np.ndarray:
        """The whole number next to each mean."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.s], dtype=np.int64)

    @property
    def rest(self) -> list[int]:
        """n times what the means are above :attr:`middle`."""
        return [s - self.n * int(m) for s, m in zip(self.s, self.middle, strict=True)]


def sums_of(whole: DataFrame) -> Sums | None:
    """Counts and sums over all vectors of the most common length; None if there is no vector."""
    sizes = whole.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return None
    d, n = most["d"], most["n"]

    def add(batches):
        high, low = np.zeros(d, dtype=np.int64), np.zeros(d, dtype=np.int64)
        for batch in batches:
            x = matrix(batch.column(0), d)
            high += (x >> _LOW).sum(axis=0)
            low += (x & ((1 << _LOW) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"k": np.arange(d), "high": high, "low": low})

    parts = whole.filter(F.size("x") == d).select("x").mapInArrow(add, "k bigint, high bigint, low bigint")
    exact = parts.groupBy("k").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    found = {r["k"]: (int(r["high"]) << _LOW) + int(r["low"]) for r in exact.collect()}
    return Sums(n, tuple(found[k] for k in range(d)))


def _added(parts: DataFrame, d: int) -> np.ndarray:
    """Matrices given as rows (k, values) of each task, added row by row; the d rows come to the driver."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": rows["k"].iloc[:1], "row": [np.sum(np.stack(rows["row"].to_list()), axis=0)]})

    found = {r["k"]: r["row"] for r in parts.groupBy("k").applyInPandas(add, "k bigint, row array<double>").collect()}
    return np.array([found.get(k, np.zeros(d)) for k in range(d)], dtype=np.float64)


def _products(rows: DataFrame, centred: Callable[[np.ndarray], np.ndarray], wide: int, d: int) -> np.ndarray:
    """Sum of z z' over the vectors z that ``centred`` makes of the rows of d numbers."""

    def multiply(batches):
        total = np.zeros((wide, wide))
        for batch in batches:
            z = centred(matrix(batch.column(0), d))
            total += z.T @ z
        yield pa.RecordBatch.from_pydict({"k": np.arange(wide), "row": list(total)}, schema=pa.schema([("k", pa.int64()), ("row", pa.list_(pa.float64()))]))

    return _added(rows.select("x").mapInArrow(multiply, "k bigint, row array<double>"), wide)


def covariance(whole: DataFrame, sums: Sums) -> np.ndarray:
    """V with divisor n, over vectors that are centred before they are multiplied."""
    middle, d = sums.middle, len(sums.s)
    products = _products(whole, lambda x: (x - middle).astype(np.float64), d, d)
    if np.abs(products).max(initial=0) >= 2.0 ** 53:  # no longer whole numbers: rounded like any double
        rest = np.array(sums.rest, dtype=np.float64) / sums.n
        return products / sums.n - np.outer(rest, rest)
    n, rest = sums.n, sums.rest
    return np.array([[(n * int(products[i, j]) - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])


# --- the operator ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """A fitted projection; ``components`` are columns of unit length."""

    sums: Sums
    values: np.ndarray
    components: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of rows of whole numbers."""
        rest = np.array([r / self.sums.n for r in self.sums.rest])
        return ((x - self.sums.middle).astype(np.float64) - rest) @ (self.components / np.sqrt(self.values))


def fit(whole: DataFrame, components: int = MAX_COMPONENTS) -> Whitening | None:
    """Sums, covariance and leading components; None without a vector or without variance."""
    sums = sums_of(whole)
    if sums is None:
        return None
    kept = whole.filter(F.size("x") == len(sums.s))
    v = covariance(kept, sums)
    values, vectors = principal(v, components)
    return Whitening(sums, values, vectors, float(np.trace(v))) if len(values) else None


def identity_error(whole: DataFrame, model: Whitening) -> float:
    """Largest entry of the covariance of the whitened vectors minus the identity."""
    k, d, n = len(model.values), len(model.sums.s), model.sums.n
    shared = whole.sparkSession.sparkContext.broadcast(model)

    def total(batches):
        t = np.zeros(k)
        for batch in batches:
            t += shared.value.project(matrix(batch.column(0), d)).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"k": np.arange(k), "t": t})

    kept = whole.filter(F.size("x") == d)
    means = np.zeros(k)
    for r in kept.select("x").mapInArrow(total, "k bigint, t double").groupBy("k").agg(F.sum("t").alias("t")).collect():
        means[r["k"]] = r["t"] / n
    products = _products(kept, lambda x: shared.value.project(x) - means, k, d)
    return float(np.abs(products / n - np.eye(k)).max())


def deviations(x: np.ndarray, sums: Sums) -> list[int | None]:
    """Sum over dimensions of (n * x - S)^2, exact; None beyond 2^63 - 1."""
    n, rest, y = sums.n, sums.rest, x - sums.middle
    largest = n * int(np.abs(y).max(initial=0)) + max(abs(r) for r in rest)
    if largest * largest * len(rest) < 1 << 63:
        z = n * y - np.array(rest, dtype=np.int64)
        return (z * z).sum(axis=1).tolist()
    exact = [sum((n * int(v) - r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y]
    return [e if e < 1 << 63 else None for e in exact]


def transform(whole: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): one row per remaining vector, coordinates by component."""
    d = len(model.sums.s)
    shared = whole.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(1), d)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(deviations(x, shared.value.sums), pa.int64()), pa.array(list(shared.value.project(x)), pa.list_(pa.float64())),
            ], schema=schema)

    rows = whole.filter(F.size("x") == d).select("vec_id", "x")
    return rows.mapInArrow(run, "vec_id bigint, deviation bigint, whitened array<double>")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = MAX_COMPONENTS) -> DataFrame:
    """One row per remaining vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    whole = whole_vectors(vectors, id_col, vector_col)
    model = fit(whole, components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    if model is None:
        kinds = ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
        return whole.filter("false").select(*[F.lit(None).cast(t).alias(c) for c, t in zip(names, kinds, strict=True)])
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    rows = transform(whole, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.sums.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(identity_error(whole, model)).alias("identity_error"),
    )
