"""Whitening of vectors: an exact distributed scatter matrix, cyclic Jacobi rotations, one small matrix sent to all tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Entries are held within these ends, so that sums over 2**43 rows stay exact in 38 digits.
LIMIT = 2**40
#: Rows of one product: sums of so many products of whole numbers below 2**20 are exact doubles.
ROWS = 4096
EPSILON = np.finfo(float).eps
LONG = 2**63
SUMS = "i int, j int, s decimal(38,0)"
EXACT = pa.decimal128(38)


@dataclass(frozen=True)
class Whitening:
    """What all tasks need: width * components numbers. sums are those of x - centre."""

    n: int
    centre: np.ndarray
    sums: list[int]
    values: np.ndarray
    trace: float
    matrix: np.ndarray


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: cyclic Jacobi rotations.

    A pair is rotated unless its entry is below the rounding error of its two diagonal entries, not of the whole matrix, which keeps
    small eigenvalues of a positive definite matrix accurate."""
    a, d = np.array(matrix, float), len(matrix)
    vectors = np.eye(d)
    for _ in range(sweeps):
        done = True
        for p in range(d - 1):
            for q in range(p + 1, d):
                if abs(a[p, q]) <= EPSILON * np.sqrt(abs(a[p, p])) * np.sqrt(abs(a[q, q])) or abs(a[p, q]) < 1e-300:
                    continue
                done = False
                slope = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if slope >= 0 else -1.0) / (abs(slope) + np.hypot(slope, 1.0))
                c = 1 / np.sqrt(t * t + 1)
                turn = np.array([[c, t * c], [-t * c, c]])
                step, pair = t * a[p, q], [p, q]
                ends = a[p, p] - step, a[q, q] + step
                a[:, pair] = a[:, pair] @ turn
                a[pair, :] = a[:, pair].T
                a[p, p], a[q, q], a[p, q], a[q, p] = *ends, 0.0, 0.0
                vectors[:, pair] = vectors[:, pair] @ turn
        if done:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of ROWS rows with their last column, lists of one width, as a matrix."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _exact(entries: list[tuple[int, int, int]]) -> pa.RecordBatch:
    from decimal import Decimal

    i, j, s = zip(*entries, strict=True) if entries else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(int(x)) for x in s], EXACT)], ["i", "j", "s"])


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums by dimension, i = -1 for its rows."""
    total, rows = 0, 0
    for _, x in _blocks(batches):
        total, rows = total + x.sum(0).astype(object), rows + len(x)
    if rows:
        yield _exact([(-1, 0, rows), *((i, 0, s) for i, s in enumerate(total))])


def products(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers, exactly: doubles where they can hold the sums, else whole numbers of any size."""
    if np.abs(y).max(initial=0) < 2**20:
        return (z := y.astype(float)).T @ z
    return (z := y.astype(object)).T @ z


def _scatter(centre: np.ndarray) -> Callable:
    """A task's exact sums of products of x - centre: the upper triangle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = np.zeros((len(centre), len(centre)), np.int64), 0
        rows, seen = 0, False
        for _, x in _blocks(batches):
            found, seen, rows = products(x - centre), True, rows + len(x)
            if found.dtype == object:
                far = far + found
            else:
                near += found.astype(np.int64)
            if rows > 2**22:  # below 2**62 so far
                far, near, rows = far + near.astype(object), np.zeros_like(near), 0
        if seen:
            total = near.astype(object) + far
            yield _exact([(i, j, total[i, j]) for i in range(len(centre)) for j in range(i, len(centre))])

    return run


def whiten(y: np.ndarray, fit: Whitening) -> np.ndarray:
    return (y - np.array([s / fit.n for s in fit.sums])) @ fit.matrix


def deviations(y: np.ndarray, fit: Whitening) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2 for each row, exactly; None where a long can't hold it."""
    most = fit.n * int(np.abs(y).max(initial=0)) + max(map(abs, fit.sums), default=0)
    if most * most * y.shape[1] < LONG:
        return ((fit.n * y - np.array(fit.sums, np.int64)) ** 2).sum(1).tolist()
    found = ((y.astype(object) * fit.n - np.array(fit.sums, object)) ** 2).sum(1)
    return [int(x) if x < LONG else None for x in found]


def _project(fit: Whitening) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches):
            y = x - fit.centre
            found = whiten(y, fit)
            values = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(deviations(y, fit), pa.int64()), values], ["vec_id", "deviation", "whitened"])

    return run


def _moments(fit: Whitening) -> Callable:
    """A task's sums of products of whitened components, j = -1 for their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = 0.0, False
        for _, x in _blocks(batches):
            w = whiten(x - fit.centre, fit)
            total, seen = total + np.column_stack((w.sum(0), w.T @ w)), True
        if seen:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel() - 1, pa.int32()), pa.array(total.ravel())], ["i", "j", "s"])

    return run


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int, offset: int) -> DataFrame:
    """id and x, the components as floor(scale * c) + offset; rows with a null or empty vector or a null or non-finite component go."""
    v = F.col(f"`{vector_col}`")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    held = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.lit(float(scale)) * c.cast("double")))).cast("long") + offset)
    return df.filter(v.isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), held.alias("x"))


def fit_whitening(rows: DataFrame, components: int = 32) -> tuple[Whitening, float]:
    """The whitening of rows (whole_vectors of one width, at least one), and the largest entry by which the whitened rows' covariance differs from the identity.

    Two passes give n, the sums S and the products of x - round(S / n), all in whole numbers, so the covariance is exact until its last division
    and no order of rows or tasks changes it. A task sends a triangle of width * width / 2 sums, added up by Spark before the driver gets them."""
    counts = {r.i: int(r.s) for r in rows.select("x").mapInArrow(_sum_up, SUMS).groupBy("i").agg(F.sum("s").alias("s")).collect()}
    n = counts.pop(-1)
    width = len(counts)
    centre = np.array([(2 * counts[i] + n) // (2 * n) for i in range(width)], np.int64)
    sums = [counts[i] - n * int(c) for i, c in enumerate(centre)]
    covariance = np.zeros((width, width))
    for r in rows.select("x").mapInArrow(_scatter(centre), SUMS).groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        covariance[r.i, r.j] = covariance[r.j, r.i] = (n * int(r.s) - sums[r.i] * sums[r.j]) / (n * n)
    values, vectors = jacobi(covariance)
    trace = float(np.trace(covariance))
    values, vectors = values[:components], vectors[:, :components]
    real = values > width * EPSILON * trace
    scaled = np.where(real, vectors / np.sqrt(np.where(real, values, 1.0)), np.nan)
    fit = Whitening(n, centre, sums, np.where(real, values, 0.0), trace, scaled)
    moments = np.zeros((int(real.sum()), int(real.sum()) + 1))
    if not moments.size:
        return fit, 0.0
    kept = Whitening(n, centre, sums, values[real], trace, scaled[:, real])
    for r in rows.select("x").mapInArrow(_moments(kept), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        moments[r.i, r.j + 1] = r.s / n
    error = moments[:, 1:] - np.outer(moments[:, 0], moments[:, 0]) - np.eye(len(moments))
    return fit, round(float(np.abs(error).max()), 12)


def whiten_vectors(df: DataFrame, components: int = 32, scale: int = 64, offset: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n, deviation, whitened (array<double>), explained (array<double>) and identity_error for each usable row of df.

    A component c becomes the whole number x = floor(scale * c) + offset. The fit is over all usable rows (n of them, sums S): whitened holds x - S / n
    projected on the first `components` eigenvectors of x's covariance, by falling eigenvalue e, over sqrt(e); explained is e over the sum of all;
    deviation is the sum of (n * x - S)**2, null where a long can't hold it; identity_error is measured on the whitened rows, to 12 places.

    Rows with a null or empty vector or a null or non-finite component go. Vectors can only be compared at one width: that of most rows (the larger, where
    two are as frequent), and rows of other widths go. scale * c is held within LIMIT. Components of no variance (as all are where n is 1, and as come up where all
    rows are equal) have e 0, explained 0 and a null whitened, and don't count in identity_error. Ids may be null or repeat: each row counts. No usable row: no
    rows. Other columns of df are not read.

    The driver holds width * width numbers (some 32 MB at 2000) and rotates them; tasks get width * components. Nothing else leaves the tasks."""
    spark = df.sparkSession
    rows = stored(whole_vectors(df, id_col, vector_col, scale, offset), "whitening-rows")
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    schema = "vec_id long, deviation long, whitened array<double>"
    if common is None:
        found, n, explained, error = spark.createDataFrame([], schema), 0, [], 0.0
    else:
        rows = rows.filter(F.size("x") == common.width)
        fit, error = fit_whitening(rows, components)
        n, explained = fit.n, (fit.values / fit.trace if fit.trace else fit.values).tolist()
        found = rows.mapInArrow(_project(fit), schema)
    told = F.array(*map(F.lit, explained)).cast("array<double>")
    return found.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", told.alias("explained"), F.lit(error).alias("identity_error"))
