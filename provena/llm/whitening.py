"""Embedding whitening: components of the covariance by spectral divide-and-conquer, then a broadcast projection.

Vectors are put on a grid of 1/256, x = floor(256 * c), so that counts, sums and deviations are exact whole numbers. The
components are fitted on each distinct x once: a vector that is copied a million times weighs as much as any other.

The covariance is summed in the tasks, from centred vectors, and only its entries (the square of the dimension, whatever the
number of rows) reach the driver. There `eigen` splits it: the polar factor U of A - s*I has the eigenvalues +1 and -1, so
(I + U) / 2 projects on the space of the eigenvalues above s. An orthonormal basis of that space and of the rest cuts A into two
smaller matrices, which are split in the same way until one dimension (or one repeated eigenvalue) is left. Polar factors come from
the dynamically weighted Halley iteration: about six rounds of QR or Cholesky, whatever the condition. Where the first few
components are wanted, the lower half is split no further once the upper half holds enough. The projection, at most four columns by
default, goes to the tasks with the function.

Defined results: rows whose vector is null, or holds a null or non-finite entry, are left out. So are vectors of another length than most
of the fit list (of equally many, the longest): they are no rows of the same covariance. Entries beyond a long on the grid are its
greatest or least value. Repeated rows are one vector of the fit list and each a row of the result; null ids are values like others. Equal
eigenvalues have any orthonormal basis of their space. A component whose variance is zero, up to rounding, has no scale: whitened is null, and the
identity error leaves it out; where the whole variance is zero, explained is null, too. A deviation that no long holds is null. An empty table
gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.llm.common import materialise, partitions

GRID = 256
COMPONENTS = 4
EPS = float(np.finfo(float).eps)
LIMIT = 1 << 63


def polar(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix that is not singular to working precision."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        least = 1 / (np.sqrt(n) * np.linalg.norm(np.linalg.inv(x), 1))
    except np.linalg.LinAlgError:
        least = EPS
    low, one = min(max(least, EPS), 1.0), np.eye(n)
    for _ in range(rounds):
        gap = np.cbrt(4 * max(1 - low**2, 0.0) / low**4)
        wa = np.sqrt(1 + gap) + np.sqrt(8 - 4 * gap + 8 * (2 - low**2) / (low**2 * np.sqrt(1 + gap))) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:
            q = np.linalg.qr(np.vstack([np.sqrt(wc) * x, one]))[0]
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            lower = np.linalg.cholesky(one + wc * x.T @ x)
            half = np.linalg.solve(lower, x.T)
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(lower.T, half).T
        moved = np.linalg.norm(new - x)
        x, low = (new + new.T) / 2, min(low * (wa + wb * low**2) / (1 + wc * low**2), 1.0)
        if moved <= np.cbrt(EPS) * 1e-3 and 1 - low <= 10 * EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the spaces of the greater and of the lesser eigenvalues of a, or None if they are all one value."""
    n = len(a)
    centre = np.trace(a) / n
    spread = np.linalg.norm(a - centre * np.eye(n))
    if spread <= 4 * EPS * np.sqrt(n) * scale:
        return None
    # The mean lies between the eigenvalues; where it hits one, a step aside does not. Steps are small against the spread.
    diagonal = np.diag(a)
    for shift in (float(np.median(diagonal)), centre, *(centre + spread / np.sqrt(n) * f for f in (0.37, -0.37, 0.11, -0.11, 0.71, -0.71, 0.023, -0.023))):
        u = polar(a - shift * np.eye(n))
        if np.linalg.norm(u @ u - np.eye(n)) > 1e-10 * n:
            continue
        k = round((n + float(np.trace(u))) / 2)
        if not 0 < k < n:
            continue
        above = (np.eye(n) + u) / 2
        basis = np.linalg.qr(above @ np.random.default_rng(0).standard_normal((n, k)))[0]
        basis = np.linalg.qr(above @ basis, mode="complete")[0]
        upper, lower = basis[:, :k], basis[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= 64 * EPS * n * scale:
            return upper, lower
    raise ArithmeticError("no shift splits the matrix")


def eigen(a: np.ndarray, wanted: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The greatest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns; all of them unless fewer are wanted."""
    a = (a + a.T) / 2
    n = len(a)
    scale, size = float(np.linalg.norm(a)), n if wanted is None else min(wanted, n)
    found: list[np.ndarray] = []
    left = [np.eye(n)]
    # The last basis on the stack is always the one of the greatest eigenvalues that are left.
    while left and sum(b.shape[1] for b in found) < size:
        basis = left.pop()
        own = basis.T @ a @ basis
        halves = _split((own + own.T) / 2, scale) if basis.shape[1] > 1 else None
        if halves is None:
            found.append(basis)
        else:
            left += [basis @ halves[1], basis @ halves[0]]
    vectors = np.hstack(found) if found else np.empty((n, 0))
    # A value is its vector's own quotient; neighbours of nearly equal value may swap by it.
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:size]
    return values[order], vectors[:, order]


@dataclass(frozen=True)
class Whitening:
    """What a fit keeps: n and sums are exact, scale is null (nan) where a component has no variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def scale(self) -> np.ndarray:
        least = EPS * len(self.sums) * (self.values[0] if len(self.values) else 0)
        return np.array([1 / np.sqrt(v) if v > least else np.nan for v in self.values])


def _valid(vector: Column) -> Column:
    """Has a vector without null and non-finite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return vector.isNotNull() & ~F.exists(vector, bad)


def _doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def _grid(vectors: pa.Array) -> np.ndarray:
    """Whole numbers of each vector of an Arrow batch, all of them of one length, as rows."""
    flat = np.floor(pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(float) * GRID)
    whole = np.clip(flat, -float(LIMIT), float(LIMIT - 1024)).astype(np.int64)
    return whole.reshape(len(vectors), -1)


def _on_grid(vector: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(vectors: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.floor(pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(float) * GRID)
        whole = np.clip(flat, -float(LIMIT), float(LIMIT - 1024)).astype(np.int64)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(whole))

    return run(vector)


def _times_n(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, in longs where they hold it and else in Python's whole numbers."""
    greatest = int(np.abs(x.astype(float)).max(initial=0)) + 1
    if n * greatest + max(map(abs, sums), default=0) < LIMIT // 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_times_n(x, n, sums) / n).astype(float)


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    y = _times_n(x, n, sums)
    greatest = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if y.dtype == object or greatest**2 * y.shape[1] >= LIMIT:
        exact = [sum(int(v) ** 2 for v in row) for row in y.tolist()]
        return pa.array([v if v < LIMIT else None for v in exact], pa.int64())
    return pa.array((y * y).sum(axis=1))


def _total(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension of fit(x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _stacked(batch) if len(batch) else np.empty((0, 0), np.int64)
            greatest = int(np.abs(x.astype(float)).max(initial=0)) + 1
            sums = (x if greatest * len(x) < LIMIT else x.astype(object)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums)), pa.int32()), pa.array([str(s) for s in sums]), pa.array([len(x)] * len(sums), pa.int64())], ["i", "s", "n"])

    rows = fit.mapInArrow(run, "i int, s string, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).orderBy("i").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Centred covariance with divisor n. A task sends one matrix, and there are no more tasks than shuffle partitions."""
    d = len(sums)
    rows_at, columns_at = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((d, d))
        for batch in batches:
            if len(batch):
                y = _centred(_stacked(batch), n, sums)
                held += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(rows_at, pa.int32()), pa.array(columns_at, pa.int32()), pa.array(held[rows_at, columns_at])], ["i", "j", "v"])

    parts = fit.coalesce(partitions(fit.sparkSession)).mapInArrow(run, "i int, j int, v double")
    out = np.zeros((d, d))
    for row in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[row["i"], row["j"]] = out[row["j"], row["i"]] = row["v"] / n
    return out


def _stacked(batch: pa.RecordBatch, at: int = 0) -> np.ndarray:
    x = batch.column(at)
    return pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(x), -1)


def _identity_error(fit: DataFrame, made: Whitening) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, as measured on it."""
    has = ~np.isnan(made.scale)
    k = int(has.sum())
    if not k:
        return None
    n, sums, project = made.n, made.sums, (made.vectors * made.scale)[:, has]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                w = _centred(_stacked(batch), n, sums) @ project
                total += w.sum(axis=0)
                products += w.T @ w
        values = [*total, *products.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["i", "v"])

    parts = fit.coalesce(partitions(fit.sparkSession)).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    values = np.array([r["v"] for r in parts])
    mean = values[:k] / n  # zero up to rounding: the vectors were centred before
    return float(np.abs(values[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def fit_whitening(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fit on every distinct vector of df; None if it has no valid one."""
    valid = df.where(_valid(_doubles(F.col(vector)))).select(_on_grid(_doubles(F.col(vector))).alias("x"))
    fit = materialise(valid.distinct(), "fit")
    sizes = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not sizes or not sizes[0]["d"]:
        return None
    fit = fit.where(F.size("x") == sizes[0]["d"])
    n, sums = _total(fit)
    covariance = _covariance(fit, n, sums)
    values, vectors = eigen(covariance, components)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    made = Whitening(n, sums, values, vectors, float(np.trace(covariance)))
    return Whitening(n, sums, values, vectors, made.trace, _identity_error(fit, made))


def whiten(df: DataFrame, made: Whitening | None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each valid row of df and each component."""
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if made is None:
        return df.sparkSession.createDataFrame([], schema)
    n, sums, k, scale, error = made.n, made.sums, len(made.values), made.scale, made.identity_error
    project = made.vectors * np.nan_to_num(scale)
    blank, shares = np.isnan(scale), [v / made.trace if made.trace > 0 else None for v in made.values.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = _grid(batch.column(1))
            w = _centred(x, n, sums) @ project
            at = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(at), n)), _deviation(x, n, sums).take(at),
                    pa.array(w.ravel(), mask=np.tile(blank, len(x))), pa.array(shares * len(x), pa.float64()), pa.array([error] * len(at), pa.float64()),
                ], schema.names,
            )

    valid = df.where(_valid(_doubles(F.col(vector))) & (F.size(vector) == len(sums)))
    return valid.select(F.col(key), _doubles(F.col(vector)).alias("_vector")).mapInArrow(run, schema)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    return whiten(df, fit_whitening(df, vector, components), key, vector)
