"""Embedding whitening by spectral divide and conquer.

The covariance of all vectors is summed up by Spark: exact sums first, then products of exactly centred vectors, added
up in each task and by pairs of dimensions across tasks, so that what reaches the driver is one matrix, bounded by the
vectors' length. Its eigenvectors come from polar decompositions. The polar factor U of a shifted
symmetric matrix is its matrix sign, (U + I) / 2 projects on the components above the shift, and an orthonormal basis of
that space and of its complement splits the matrix in two smaller ones, which are treated alike until all
are single numbers. The polar factor is found by the dynamically weighted Halley iteration in its inverse-free form, on
QR decompositions. The components, a small matrix, then go to all tasks, which whiten their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglens.llm.common import bounded_batches, frozen, returning_memory

SCALE, SHIFT = 1024.0, 100_000
MOST_DIMENSIONS = 4096  # of the matrix that the driver decomposes
EPS = np.finfo(float).eps


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix by QR-based dynamically weighted Halley steps.

    Along a direction on which ``a`` vanishes the factor is no orthogonal one; the caller must choose its shift so that
    there is none.
    """
    n = len(a)
    x = a / np.linalg.norm(a)
    # A lower bound of the smallest singular value; too low a bound costs a step or two.
    try:
        low = min(1.0, max(1 / np.linalg.norm(np.linalg.inv(x)), EPS))
    except np.linalg.LinAlgError:
        low = EPS
    eye = np.eye(n)
    for _ in range(30):
        square = low * low
        d = np.cbrt(4 * (1 - square) / square**2) if square < 1 else 0.0
        weight = np.sqrt(1 + d) + 0.5 * np.sqrt(8 - 4 * d + 8 * (2 - square) / (square * np.sqrt(1 + d)))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = (b / c) * x + (weight - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        new = (new + new.T) / 2
        moved = np.linalg.norm(new - x)
        x, low = new, min(1.0, low * (weight + b * square) / (1 + c * square))
        if moved <= 4 * EPS * n and abs(1 - low) <= 16 * EPS:
            break
    return x


def _range_of(projector: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of a projector's range and of its complement, by subspace iteration from its largest columns."""
    order = np.argsort(-np.diag(projector), kind="stable")
    start = np.linalg.qr(projector[:, order[:rank]])[0] if rank else np.zeros((len(projector), 0))
    basis = np.linalg.qr(np.hstack([start, np.eye(len(projector))]))[0][:, : len(projector)]
    for _ in range(3):
        inner = np.linalg.qr(projector @ basis[:, :rank])[0]
        outer = basis[:, rank:] - projector @ basis[:, rank:]
        basis = np.linalg.qr(np.hstack([inner, outer]))[0]
    return basis[:, :rank], basis[:, rank:]


def spectral(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and its eigenvectors as columns, by divide and conquer."""
    values, vectors = _divide((a + a.T) / 2, float(np.linalg.norm(a)) if a.size else 0.0)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _divide(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(a)
    diagonal = np.diag(a).copy()
    rest = np.linalg.norm(a - np.diag(diagonal))
    if n <= 1 or rest <= EPS * scale:
        return diagonal, np.eye(n)
    if n == 2:
        angle = 0.5 * np.arctan2(2 * a[0, 1], a[0, 0] - a[1, 1])
        turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
        return np.diag(turn.T @ a @ turn).copy(), turn
    # The eigenvalues' extent about their mean says how far a shift may lie from it.
    mean = diagonal.mean()
    spread = np.linalg.norm(a - mean * np.eye(n)) / np.sqrt(n)
    if spread <= EPS * scale:
        return diagonal, np.eye(n)
    shifts = [np.median(diagonal), mean, *(mean + spread * t for t in (0.3, -0.3, 0.7, -0.7, 0.11, -0.11, 1.0, -1.0, 0.01, -0.01))]
    best = None
    for shift in shifts:
        projector = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        rank = int(round(np.trace(projector)))
        if not 0 < rank < n:
            continue
        upper, lower = _range_of(projector, rank)
        left_over = np.linalg.norm(upper.T @ a @ lower)
        if best is None or left_over < best[0]:
            best = (left_over, upper, lower)
        if left_over <= 8 * n * EPS * scale:
            break
    if best is None:
        raise ArithmeticError("no shift splits the spectrum")
    _, upper, lower = best
    parts = []
    for basis in (upper, lower):
        inner = basis.T @ a @ basis
        values, vectors = _divide((inner + inner.T) / 2, scale)
        parts.append((values, basis @ vectors))
    return np.concatenate([p[0] for p in parts]), np.hstack([p[1] for p in parts])


def whole_numbers(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: float = SCALE, shift: int = SHIFT
) -> DataFrame:
    """(vec_id, x) with x = floor(scale * component) + shift, of the rows that take part.

    Vectors that are null or empty or hold null or non-finite entries do not. A null id is kept.
    """
    c = F.col(vector_column).cast("array<double>")
    odd = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    x = F.transform(c, lambda v: F.floor(F.lit(scale) * v) + F.lit(shift))
    return table.filter(c.isNotNull() & (F.size(c) > 0) & ~odd).select(F.col(id_column).alias("vec_id"), x.cast("array<long>").alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], at: int, length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            column = batch.column(at)
            if (column.value_lengths().to_numpy(zero_copy_only=False) != length).any():
                raise ValueError("vectors must be of one length")
            yield batch, column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, length)


@dataclass(frozen=True)
class Components:
    """The fit: what whitens, and the rows it was fitted on."""

    rows: DataFrame
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # as columns; in each the entry of largest size is positive
    trace: float


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as exact whole numbers, of Python's kind where 64 bits might not hold them."""
    most = n * (int(np.abs(x).max(initial=0)) + 1) + max(map(abs, sums), default=0)
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def fit(rows: DataFrame, components: int = 8) -> Components:
    """The ``components`` largest principal components of the column ``x`` of whole numbers, vectors of one length.

    Covariance has divisor n and is centred before multiplying. Without rows there are no components; there are no
    more than dimensions. Vectors of different lengths, and of over ``MOST_DIMENSIONS`` entries, are an error.
    """
    bounded_batches(rows.sparkSession)
    head = rows.select(F.size("x").alias("d")).agg(F.max("d").alias("d"), F.min("d").alias("e"), F.count("*").alias("n")).first()
    n, length = head["n"], head["d"]
    if not n:
        return Components(rows, 0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    if length != head["e"] or length > MOST_DIMENSIONS:
        raise ValueError(f"vectors must be of one length, at most {MOST_DIMENSIONS}")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, object)
        for _, x in _matrices(batches, 0, length):
            total += x.sum(axis=0).astype(object) if np.abs(x).max() < 2**62 // len(x) else x.astype(object).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(length), pa.int32()), "s": pa.array(map(str, total), pa.string())})

    added = rows.select("x").mapInArrow(returning_memory(sums), "i int, s string")
    found = added.groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    s = [int(r["s"]) for r in sorted(found, key=lambda r: r["i"])]

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((length, length))
        for _, x in _matrices(batches, 0, length):
            centred = _scaled(x, n, s).astype(float) / n
            total += centred.T @ centred
        i, j = np.triu_indices(length)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    added = rows.select("x").mapInArrow(returning_memory(products), "i int, j int, v double")
    found = added.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    v = np.zeros((length, length))
    v[found["i"], found["j"]] = found["v"] / n
    v = np.triu(v) + np.triu(v, 1).T
    values, vectors = spectral(v)
    values, vectors = np.maximum(values[:components], 0.0), vectors[:, :components]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return Components(rows, n, s, values, vectors, float(np.trace(v)))


_WHITE = T.StructType(
    [T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
)


def whiten(fitted: Components) -> DataFrame:
    """One row for each row of the fit and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``deviation`` is the exact sum of (n * x - S)^2 over all dimensions; where 64 bits cannot hold it, the job fails.
    A component without variance (an eigenvalue of rounding size, as with one row or equal rows) has no whitened value: null.
    ``identity_error`` is the largest entry, by size, of the whitened values' covariance minus the identity, over
    components with variance; null without any. Repeated rows are rows of their own.
    """
    n, s, length = fitted.n, fitted.sums, len(fitted.sums)
    real = fitted.values > length * EPS * max(fitted.trace, 0.0) if len(fitted.values) else np.zeros(0, bool)
    weights = fitted.vectors[:, real] / np.sqrt(fitted.values[real]) if len(fitted.values) else np.zeros((0, 0))
    real, shown = real.tolist(), len(fitted.values)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, 1, length):
            exact = _scaled(x, n, s)
            if length * (float(np.abs(exact).max(initial=0)) + 1) ** 2 < 2.0**62:
                deviation = (exact * exact).sum(axis=1)
            else:
                deviation = (exact.astype(object) ** 2).sum(axis=1).tolist()
                if max(deviation) >= 1 << 63:
                    raise OverflowError("a deviation needs more than 64 bits")
            found = (exact.astype(float) / n) @ weights
            whole = np.full((len(x), shown), np.nan)
            whole[:, real] = found
            flat = pa.array(whole.reshape(-1), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([n] * len(x), pa.int64()), pa.array(deviation, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(range(0, shown * len(x) + 1, shown), pa.int32()), flat),
                ],
                names=["vec_id", "n", "deviation", "whitened"],
            )

    schema = T.StructType([fitted.rows.schema["vec_id"], *_WHITE.fields])
    rows = fitted.rows.select("vec_id", "x")
    if not shown:
        white, error = rows.limit(0).select("vec_id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in _WHITE)), None
    else:
        white = frozen(rows.mapInArrow(returning_memory(step), schema), "whitened")
        error = identity_error(white, [i for i in range(shown) if real[i]])
    explained = F.array(*(F.lit(float(e / fitted.trace) if fitted.trace > 0 else None).cast("double") for e in fitted.values))
    each = white.select("vec_id", "n", "deviation", explained.alias("parts"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", "whitened",
        F.get("parts", F.col("at")).cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def identity_error(white: DataFrame, at: list[int]) -> float | None:
    """Largest entry, by size, of the covariance of the column ``whitened`` at the places ``at`` minus the identity."""
    if not at:
        return None
    columns = [F.get("whitened", F.lit(i)) for i in at]
    means = white.agg(*(F.avg(c).alias(f"m{k}") for k, c in enumerate(columns))).first()
    centred = [c - F.lit(means[k]) for k, c in enumerate(columns)]
    pairs = [(a, b) for a in range(len(at)) for b in range(a, len(at))]
    found = white.agg(*(F.avg(centred[a] * centred[b]).alias(f"c{a}_{b}") for a, b in pairs)).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)
