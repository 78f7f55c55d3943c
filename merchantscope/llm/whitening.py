"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Vectors become integers (floor of a scaled component). The distinct ones are the fit
list; their sums and their scatter around the rounded mean are summed as whole numbers
on Spark, so the covariance is exact before it is rounded once. Its pivoted Cholesky factor
L (V = L L' in pivot order) is rotated column by column until the columns are
orthogonal: then their squared norms are the eigenvalues of V and the normalised columns
its eigenvectors. That part works on a matrix of dimension x dimension only.

Through the driver go one row per matrix cell, whatever the number of vectors; the tasks
sum up their cells first. A vector that very many rows share is one row of the fit list,
combined before the shuffle.

Edge cases: null vectors and those with a null or non-finite component take no part, nor do
empty ones and those of another length than the most frequent one (the longer of equally
frequent ones); rows keep null and repeated ids; a fit list of rank r has min(r, 4)
components, so equal vectors only (rank 0) give no rows, as does an empty table; a deviation
beyond a long is null. Whole numbers are exact up to 38 digits in a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table, table

#: Rows that a task multiplies at a time.
BLOCK = 4096
#: Whole numbers below these sums are exact in floats and in longs.
_FLOAT, _LONG = 1 << 53, 1 << 62


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list with sums S; components (rows) by falling eigenvalue, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def shift(self) -> list[int]:
        """The mean, rounded to whole numbers: what is left of a sum is less than n."""
        return [(2 * s + self.n) // (2 * self.n) for s in self.sums]


def floor_vectors(df: DataFrame, vector: str, scale: int, id_: str) -> DataFrame:
    """Stored (id, v): floor(scale * c) of whole, finite vectors of the most frequent length."""
    x = F.col(vector)
    fine = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))))
    v = F.transform(x, lambda y: F.floor(F.lit(float(scale)) * y.cast("double")).cast("long"))
    whole = df.filter(x.isNotNull() & (F.size(x) > 0) & fine).select(F.col(id_).alias("id"), v.alias("v"))
    stored = stage_table(whole, "floored")
    lengths = stored.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return stored.filter(F.size("v") == (lengths[0]["d"] if lengths else 0))


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "v") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for low in range(0, batch.num_rows, BLOCK):
            part = batch.slice(low, BLOCK)
            yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0


def _minus(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift, as longs where that is safe, else as Python's whole numbers."""
    safe = _largest(x) + max(map(abs, shift)) < _LONG
    return x - np.array(shift, np.int64) if safe else x.astype(object) - np.array(shift, object)


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y' y."""
    bound = _largest(y) ** 2 * len(y)
    if bound < _FLOAT:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    return y.T @ y if bound < _LONG else y.T.astype(object) @ y.astype(object)


def _summed(cells: DataFrame) -> dict[int, int]:
    """Cells (i, x) of all tasks, added up; as many rows as there are cells reach the driver."""
    return {r["i"]: int(r["x"]) for r in cells.groupBy("i").agg(F.sum("x").alias("x")).collect()}


def _cells(values: np.ndarray) -> pa.RecordBatch:
    flat = [str(int(v)) for v in values.ravel()]
    return pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], names=["i", "x"])


def _totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for _, x in _blocks(batches):
            safe = _largest(x) * len(x) < _LONG
            own = (x if safe else x.astype(object)).sum(0).astype(object)
            total = total + np.append(np.array([len(x)], object), own)
        if not isinstance(total, int):
            yield _cells(total)

    summed = _summed(fit.mapInArrow(run, "i int, x string").withColumn("x", F.col("x").cast("decimal(38,0)")))
    return summed.get(0, 0), [summed[i] for i in range(1, len(summed))]


def _scatter(fit: DataFrame, shift: list[int]) -> np.ndarray:
    """Sum of (x - shift)(x - shift)' as whole numbers; tasks send one triangle."""
    d = len(shift)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | int = 0
        for _, x in _blocks(batches):
            total = total + _products(_minus(x, shift))[upper].astype(object)
        if not isinstance(total, int):
            yield _cells(total)

    summed = _summed(fit.mapInArrow(run, "i int, x string").withColumn("x", F.col("x").cast("decimal(38,0)")))
    out = np.zeros((d, d), object)
    out[upper] = [summed[i] for i in range(len(upper[0]))]
    return np.where(np.tri(d, k=-1, dtype=bool), out.T, out)


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """Factor (rows in the matrix's own order, a column per pivot) with matrix = factor factor'.

    The largest remaining diagonal entry is the next pivot; columns end at the rank.
    """
    d = len(matrix)
    left, factor = np.diag(matrix).astype(float).copy(), np.zeros((d, d))
    limit = d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(np.argmax(left))
        if left[p] <= limit:
            return factor[:, :k]
        factor[:, k] = (matrix[:, p] - factor[:, :k] @ factor[p, :k]) / np.sqrt(left[p])
        left -= factor[:, k] ** 2
        left[p] = -np.inf
    return factor


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (rows) of factor factor', by rotating pairs of columns."""
    g = np.array(factor, float, order="F")
    for _ in range(sweeps):
        turned = False
        for i in range(g.shape[1] - 1):
            for j in range(i + 1, g.shape[1]):
                a, b, c = g[:, i] @ g[:, i], g[:, j] @ g[:, j], g[:, i] @ g[:, j]
                if abs(c) <= 1e-15 * np.sqrt(a * b):
                    continue
                turned = True
                zeta = (b - a) / (2 * c)
                t = (1.0 if zeta >= 0 else -1.0) / (abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                g[:, i], g[:, j] = cos * (g[:, i] - t * g[:, j]), cos * (t * g[:, i] + g[:, j])
        if not turned:
            break
    norms = np.linalg.norm(g, axis=0)
    order = np.argsort(-norms, kind="stable")
    vectors = (g[:, order] / norms[order]).T
    largest = vectors[np.arange(len(vectors)), np.argmax(abs(vectors), 1)] if len(vectors) else np.zeros(0)
    return norms[order] ** 2, vectors * np.sign(largest)[:, None]


def fit_whitening(fit: DataFrame) -> Whitening | None:
    """Model of the vectors ``v`` of ``fit`` (each counts once); None without vectors."""
    n, sums = _totals(fit)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros(0), np.zeros((0, len(sums))), 0.0)
    shift = model.shift()
    rest = [s - n * m for s, m in zip(sums, shift)]
    scatter = _scatter(fit, shift)
    exact = [[n * int(scatter[i, j]) - rest[i] * rest[j] for j in range(len(sums))] for i in range(len(sums))]
    covariance = np.array([[x / (n * n) for x in row] for row in exact])
    values, components = jacobi_columns(pivoted_cholesky(covariance))
    return Whitening(n, sums, values, components, sum(exact[i][i] for i in range(len(sums))) / (n * n))


def _centred(x: np.ndarray, model: Whitening, shift: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - shift, and the whole numbers n * x - S."""
    y = _minus(x, shift)
    rest = [s - model.n * m for s, m in zip(model.sums, shift)]
    safe = _largest(y) * model.n + max(map(abs, rest)) < _LONG
    whole = y * model.n - np.array(rest, np.int64) if safe else y.astype(object) * model.n - np.array(rest, object)
    return y, whole


def whiten(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(id, deviation, w): whitened coordinates of the leading components of each row's vector."""
    k = min(components, len(model.values))
    shift = model.shift()
    axes = (model.components[:k] / np.sqrt(model.values[:k])[:, None]).T
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, shift)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            y, whole = _centred(x, model, shift)
            w = (y.astype(np.float64) - rest) @ axes
            safe = _largest(whole) ** 2 * whole.shape[1] < _LONG
            squares = (whole.astype(np.int64 if safe else object) ** 2).sum(1)
            longs = [int(s) if s < 1 << 63 else None for s in squares]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(longs, pa.int64()), pa.array(list(w), pa.list_(pa.float64()))], names=["id", "deviation", "w"]
            )

    kind = vectors.schema["id"].dataType.simpleString()
    return vectors.select("id", "v").mapInArrow(run, f"id {kind}, deviation long, w array<double>")


def identity_error(fit: DataFrame, model: Whitening, components: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = min(components, len(model.values))
    shift = model.shift()
    axes = (model.components[:k] / np.sqrt(model.values[:k])[:, None]).T
    rest = np.array([(s - model.n * m) / model.n for s, m in zip(model.sums, shift)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for _, x in _blocks(batches):
            w = (_minus(x, shift).astype(np.float64) - rest) @ axes
            total += np.append(w.sum(0), (w.T @ w).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["i", "x"])

    cells = fit.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros(k + k * k)
    for r in cells:
        sums[r["i"]] = r["x"] / model.n
    mean, square = sums[:k], sums[k:].reshape(k, k)
    return float(abs(square - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whitened_rows(
    df: DataFrame, components: int = 4, scale: int = 256, id_: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    vectors = floor_vectors(df, vector, scale, id_)
    fit = stage_table(vectors.select("v").distinct(), "fit_list")
    model = fit_whitening(fit)
    k = min(components, len(model.values)) if model else 0
    if not k:
        nothing = vectors.filter("false").select(F.col("id").alias(id_), F.lit(0).alias("component"))
        return nothing.selectExpr("*", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]])
    each = whiten(vectors, model, k).select("id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return each.select(
        F.col("id").alias(id_),
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(identity_error(fit, model, k)).alias("identity_error"),
    )


def op13_jacobi_whitening(spark, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))
