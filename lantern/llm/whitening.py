"""Whitening of embeddings by the leading components of their covariance.

Sums and centred products are counted in the partitions as exact integers and added up by Spark, so the covariance is
the same however the rows are dealt. Its eigenvalues and vectors are found on the driver, from a matrix of the
dimension's square: Householder reflections make it tridiagonal, Sturm counts bisect the leading eigenvalues, inverse
iteration finds their vectors, and those of close eigenvalues are made orthogonal to each other in every step. The
components are then broadcast and every row is projected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lantern.llm.common import prepare, read

COMPONENTS = 32
#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Rows that are multiplied at a time.
ROWS = 4096
_MASK = (1 << 32) - 1


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix of doubles) of the rows whose vector is there and has finite entries only."""
    there = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    own = column.take(pa.array(there))
    lengths = np.diff(own.offsets.to_numpy())
    if there.size and lengths.min() != lengths.max():
        raise ValueError("the vectors have different lengths")
    entries = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(there), int(lengths[0]) if there.size else 0)  # a null entry is nan
    fine = np.isfinite(entries).all(axis=1)
    return there[fine], entries[fine]


def _whole(entries: np.ndarray, scale: int, shift: int) -> np.ndarray:
    scaled = np.floor(scale * entries)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("an entry is too large for a long")
    return scaled.astype(np.int64) + shift


def _products(z: np.ndarray) -> Iterator[np.ndarray]:
    """Integer matrices that add up to z'z. Products of doubles are exact while the sums stay below 2 ** 53."""
    most = int(np.abs(z).max()) if z.size else 0
    if most >= 1 << 26:
        wide = z.astype(object)
        for a in range(0, len(z), ROWS):
            yield wide[a : a + ROWS].T @ wide[a : a + ROWS]
        return
    step = max(1, min(ROWS, (1 << 53) // max(1, most * most)))
    real = z.astype(np.float64)
    for a in range(0, len(z), step):
        yield (real[a : a + step].T @ real[a : a + step]).astype(np.int64)


#: Longs that a sum is kept in, by 32 bits each, the last one with all bits beyond.
LIMBS = 4


class _Sum:
    """Integers of up to some 150 bits, added up limb by limb."""

    def __init__(self) -> None:
        self.limbs: np.ndarray | None = None

    def add(self, values: np.ndarray) -> None:
        if self.limbs is None:
            self.limbs = np.zeros((LIMBS, *values.shape), np.int64)
        used = LIMBS if values.dtype == object else 2
        for k in range(used):
            part = values >> 32 * k
            self.limbs[k] += (part if k == used - 1 else part & _MASK).astype(np.int64)


def _added(rows: DataFrame) -> dict[tuple[int, int], int]:
    """Exact sums by (i, j); Spark adds up in each task before it shuffles. Some dimension's square of rows come back."""
    sums = rows.groupBy("i", "j").agg(*(F.sum(f"limb{k}").alias(f"limb{k}") for k in range(LIMBS)))
    return {(r.i, r.j): sum(r[f"limb{k}"] << 32 * k for k in range(LIMBS)) for r in sums.collect()}


@dataclass(frozen=True)
class Whitening:
    """What a projection needs: a row's x is floor(scale * c) + shift, and center + rest / n is the mean of x."""

    n: int
    center: np.ndarray
    rest: np.ndarray
    values: np.ndarray  # leading eigenvalues, falling
    vectors: np.ndarray  # a unit eigenvector per row
    trace: float
    scale: int
    shift: int

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x."""
        return ((x - self.center) - self.rest / self.n) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Of each row the exact sum over dimensions of (n * x - S) ** 2."""
        z = x - self.center
        most = self.n * (int(np.abs(z).max()) if z.size else 0) + int(np.abs(self.rest).max(initial=0))
        if z.shape[1] * most * most < 1 << 62:
            return ((self.n * z - self.rest) ** 2).sum(axis=1).tolist()
        return ((self.n * z.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1).tolist()


def _tasks(source: DataFrame, per_batch: Callable[[np.ndarray], Iterator[np.ndarray]], integers: bool, scale: int, shift: int) -> DataFrame:
    """(i, j, limb0, limb1, ...) or (i, j, value): what per_batch gives for a batch's rows x, added up within each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, real = _Sum(), 0.0
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                _, entries = _vectors(b.column(0).slice(a, ROWS))
                if not len(entries):
                    continue
                for values in per_batch(_whole(entries, scale, shift)):
                    if integers:
                        total.add(values)
                    else:
                        real = real + values
        found = total.limbs if integers else None if isinstance(real, float) else real[None]
        if found is None:
            return
        square = found.shape[1] > 1
        i, j = np.nonzero(np.triu(np.ones(found.shape[1:], bool)) if square else np.ones(found.shape[1:], bool))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (i, j, *(v[i, j] for v in found))], ["i", "j", *names])

    names = [f"limb{k}" for k in range(LIMBS)] if integers else ["value"]
    return source.mapInArrow(run, "i long, j long, " + ", ".join(f"{x} {'long' if integers else 'double'}" for x in names))


def _fit(source: DataFrame, components: int, scale: int, shift: int) -> Whitening | None:
    def first(x: np.ndarray) -> Iterator[np.ndarray]:
        wide = np.abs(x).max(initial=0) >= 1 << 40
        yield np.concatenate([[len(x), x.size], x.astype(object).sum(axis=0) if wide else x.sum(axis=0)])[None]

    totals = _added(_tasks(source, first, True, scale, shift))
    if not totals:
        return None
    n, size, *sums = (totals[k] for k in sorted(totals))
    if size != n * len(sums):
        raise ValueError("the vectors have different lengths")
    if not sums:
        return None
    center = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)  # the mean, rounded
    rest = [s - n * int(m) for s, m in zip(sums, center, strict=True)]
    products = _added(_tasks(source, lambda x: _products(x - center), True, scale, shift))
    d = len(sums)
    covariance = np.empty((d, d))
    for (i, j), p in products.items():  # of whole numbers, so that each entry is rounded once
        covariance[i, j] = covariance[j, i] = (n * p - rest[i] * rest[j]) / (n * n)
    values, vectors = leading(covariance, min(components, d))
    return Whitening(n, center, np.array(rest, np.int64), values, vectors, float(np.trace(covariance)), scale, shift)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix, by Householder reflections."""
    a, n = a.copy(), len(a)
    off, reflectors = np.zeros(max(0, n - 1)), []
    for k in range(n - 1):
        x = a[k + 1 :, k]
        norm = float(np.linalg.norm(x))
        v = x.copy()
        v[0] += norm if v[0] >= 0 else -norm
        size = float(np.linalg.norm(v))
        if k == n - 2 or size == 0:
            off[k] = x[0]
            reflectors.append(np.zeros(n - k - 1))
            continue
        off[k] = -norm if x[0] >= 0 else norm
        v /= size
        reflectors.append(v)
        block = a[k + 1 :, k + 1 :]
        p = block @ v
        w = p - (p @ v) * v
        block -= 2 * (np.outer(v, w) + np.outer(w, v))
    return np.diag(a).copy(), off, reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues are less than each number of `at`: the negative pivots of T - at (Sturm)."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    q = diagonal[0] - at
    count = (q < 0).astype(np.int64)
    for d, e in zip(diagonal[1:], off, strict=True):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        with np.errstate(over="ignore"):  # an infinite pivot has the right sign
            q = d - at - e * e / q
        count += q < 0
    return count


def bisected(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected by Sturm counts to the last digits."""
    n = len(diagonal)
    around = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    low, high = float((diagonal - around).min()), float((diagonal + around).max())
    spread = max(abs(low), abs(high), np.finfo(float).tiny)
    lows, highs = np.full(k, low - 1e-12 * spread), np.full(k, high + 1e-12 * spread)
    rank = n - np.arange(k)  # the i-th largest has n - i eigenvalues up to itself
    for _ in range(200):
        middle = (lows + highs) / 2
        under = below(diagonal, off, middle) >= rank
        highs, lows = np.where(under, middle, highs), np.where(under, lows, middle)
        if np.all(highs - lows <= 2 * np.finfo(float).eps * np.maximum(np.abs(lows), np.abs(highs)) + np.finfo(float).tiny):
            break
    return (lows + highs) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, least: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (T - shift) y = b by elimination with row exchanges; pivots under `least` are replaced by it."""
    n = len(diagonal)
    main, upper, second = (diagonal - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    lower = off.tolist()
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        if abs(lower[i]) > abs(main[i]):
            swapped[i] = True
            factor[i] = main[i] / lower[i]
            main[i], main[i + 1], rest = lower[i], upper[i] - factor[i] * main[i + 1], main[i + 1]
            upper[i], second[i] = rest, upper[i + 1]
            upper[i + 1] = -factor[i] * second[i]
        else:
            pivot = main[i] if abs(main[i]) >= least else least
            main[i], factor[i] = pivot, lower[i] / pivot
            main[i + 1] -= factor[i] * upper[i]
    if abs(main[-1]) < least:
        main[-1] = least

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.tolist()
        for i in range(n - 1):
            if swapped[i]:
                y[i], y[i + 1] = y[i + 1], y[i] - factor[i] * y[i + 1]
            else:
                y[i + 1] -= factor[i] * y[i]
        y[-1] /= main[-1]
        for i in range(n - 2, -1, -1):
            y[i] = (y[i] - upper[i] * y[i + 1] - (second[i] * y[i + 2] if i + 2 < n else 0.0)) / main[i]
        return np.array(y)

    return solve


def iterated(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray, rounds: int = 12) -> np.ndarray:
    """A unit eigenvector of the tridiagonal matrix per value, by inverse iteration.

    Values that lie close together form a cluster, whose vectors are made orthogonal to those before in each round.
    """
    n = len(diagonal)
    around = np.abs(np.concatenate([[0], off])) + np.abs(np.concatenate([off, [0]]))
    norm = max(float((np.abs(diagonal) + around).max()), np.finfo(float).tiny)
    eps = np.finfo(float).eps
    out, cluster, shift = np.empty((len(values), n)), 0, np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * norm:
            cluster = k
        shift = min(value, shift - 2 * eps * norm) if k > cluster else value  # equal values would give one vector
        solve = _solver(diagonal, off, shift, eps * norm)
        y = np.random.default_rng(k).standard_normal(n)
        for _ in range(rounds):
            y = solve(y / np.linalg.norm(y))
            grown = np.linalg.norm(y)
            for _ in range(2):
                y -= out[cluster:k].T @ (out[cluster:k] @ y)
            y /= np.linalg.norm(y)
            if grown * eps * norm * 100 >= 1 and _residual(diagonal, off, y, value) <= 4 * eps * norm:
                break
        out[k] = y
    return out


def _residual(diagonal: np.ndarray, off: np.ndarray, y: np.ndarray, value: float) -> float:
    r = (diagonal - value) * y
    r[:-1] += off * y[1:]
    r[1:] += off * y[:-1]
    return float(np.linalg.norm(r))


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors by row) of the k largest eigenvalues of a symmetric matrix, without those that are 0 but for rounding."""
    diagonal, off, reflectors = tridiagonal(a)
    values = bisected(diagonal, off, k)
    values = values[values > max(len(a) * np.finfo(float).eps * values.max(initial=0), 1e-290)]
    vectors = iterated(diagonal, off, values).T
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        vectors[i + 1 :] -= 2 * np.outer(v, v @ vectors[i + 1 :])
    return values, vectors.T.copy()


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per remaining row and leading component.

    Rows whose vector is null, or holds a null or an entry that is not finite, are left out. Null and repeated ids and
    repeated rows stay and count; extra columns are not read. Vectors of different lengths, or entries beyond a long, are
    an error. A component whose eigenvalue is 0 but for rounding cannot be whitened and has no rows, so fewer
    dimensions, or all rows equal, give fewer components or none; no remaining rows give no rows. deviation is
    decimal(38, 0). identity_error is measured on the whitened rows, in a pass of its own.
    """
    spark = vectors.sparkSession
    prepare(spark)
    schema = "vec_id long, component int, deviation decimal(38,0), whitened double"
    both = vectors.select(F.col(vector_col).cast("array<double>").alias("vector"), F.col(id_col).cast("long").alias("vec_id"))
    fit = _fit(both.select("vector"), components, scale, shift)
    if fit is None or not len(fit.values):
        rows = spark.createDataFrame([], schema)
        n, explained, error = 0, [], 0.0
    else:
        shared = spark.sparkContext.broadcast(fit)
        squares = lambda x: iter([(w := shared.value.project(x)).T @ w])  # noqa: E731  the projection is centred already
        sums = _tasks(both.select("vector"), squares, False, scale, shift).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
        n, explained = fit.n, (fit.values / fit.trace).tolist()
        error = max(abs(r.value / n - (r.i == r.j)) for r in sums)
        k = len(fit.values)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, ROWS):
                    part = b.slice(a, ROWS)
                    at, entries = _vectors(part.column(0))
                    if not len(at):
                        continue
                    x = _whole(entries, scale, shift)
                    repeated = pa.array(np.repeat(np.arange(len(at)), k))
                    deviation = pa.array(shared.value.deviation(x), pa.decimal128(38, 0))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(1).take(pa.array(at)).take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), deviation.take(repeated), pa.array(shared.value.project(x).ravel())],
                        ["vec_id", "component", "deviation", "whitened"],
                    )

        rows = both.select("vector", "vec_id").mapInArrow(run, schema)
    share = F.element_at(F.array(*(F.lit(x) for x in explained)), F.col("component")) if explained else F.lit(None).cast("double")
    return rows.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """All embeddings. A deviation beyond a long, from some 10 ** 8 rows on, is null there and whole in deviation_wide."""
    found = whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation_wide", F.col("deviation")).withColumn("deviation", F.col("deviation").try_cast("long"))
