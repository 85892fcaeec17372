"""Whitening of embeddings by their leading principal components, found by Chebyshev-filtered subspace iteration.

The fit list holds each distinct vector once. A pass over it is one job: every task centres its rows and adds up its share
of X'XQ for a block Q of a few columns; only those d by b sums leave the tasks, and Spark adds them. No task, and not the driver,
ever forms the covariance or holds the vectors. An iteration filters the block with the Chebyshev polynomial that is small on
[0, cut], the unwanted part of the spectrum (the covariance has no negative eigenvalue; cut is the least Ritz value of the
block, which has more columns than components are asked for), makes it orthonormal (QR) and solves the projected problem
(Rayleigh-Ritz), whose pass also gives the residuals. The iterations end when every wanted pair is certified: |Vq - eq| is at most
`tolerance` times the largest eigenvalue, or no longer falls and is at most 100 times that. Else an error is raised.

Entries c become the whole numbers floor(scale * c) + offset. Rows whose vector is null or has null or non-finite entries are
dropped, and so are those without a defined place in the space: entries of 2**53 / scale and beyond, which whole numbers in
doubles cannot hold, and vectors whose length is not the most frequent one (of equally frequent ones the greatest); an
empty vector counts as having no place either. Fewer components come out where the covariance has fewer eigenvalues above
1e-12 of its trace (equal vectors only: none, so no rows). Equal eigenvalues have no directions of their own: any orthonormal ones are
given. Rows with a null vec_id are rows like others, repeated rows stay repeated (the fit list has their vector once),
an empty table gives an empty result, extra columns are ignored. Vectors of any length work as long as d by b sums fit a task.
A deviation beyond the range of a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.llm.common import matrix, stored

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
DEGREE = 12
TOLERANCE = 2e-14
MOST_ITERATIONS = 40


def whole_vectors(rows: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(vec_id, x): the usable rows' vectors as whole numbers."""
    e = F.col("embedding")
    limit = 2.0**53 / scale
    usable = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda c: F.coalesce(F.abs(c) < limit, F.lit(False)) & ~F.isnan(c))
    rows = rows.select("vec_id", "embedding").where(usable)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("long") + offset).alias("x"))


def _summed(partial: DataFrame, width: int) -> np.ndarray:
    """The sum of the tasks' matrices, given as rows (i, y)."""
    rows = partial.groupBy("i").agg(F.array(*(F.sum(F.get("y", F.lit(k))) for k in range(width))).alias("y")).collect()
    out = np.zeros((len(rows), width))
    for r in rows:
        out[r.i] = r.y
    return out


def _matrix_rows(sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(list(sums), pa.list_(pa.float64()))], ["i", "y"])


def covariance_pass(fit: DataFrame, mean: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
    """V q, V being the covariance of fit's vectors x: each task centres its rows, multiplies and adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros_like(q)
        for b in batches:
            if b.num_rows:
                c = matrix(b.column(0)) - mean
                sums += c.T @ (c @ q)
        yield _matrix_rows(sums)

    return _summed(fit.select("x").mapInArrow(run, "i int, y array<double>"), q.shape[1]) / n


def leading_components(fit: DataFrame, mean: np.ndarray, n: int, trace: float, count: int = COMPONENTS, degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of the covariance; at most count, those above 1e-12 of the trace."""
    d = len(mean)
    count = min(count, d)
    width = min(d, 2 * count + 8)
    q = np.linalg.qr(np.random.default_rng(13).standard_normal((d, width)))[0]
    best = np.inf
    for step in range(MOST_ITERATIONS):
        vq = covariance_pass(fit, mean, n, q)
        small = q.T @ vq
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, vq = q @ turn, vq @ turn
        wanted = values[:count] > 1e-12 * trace
        residual = np.linalg.norm(vq[:, :count] - q[:, :count] * values[:count], axis=0)[wanted].max(initial=0.0) / max(values[0], 1e-300)
        if not wanted.any() or residual <= tolerance or (width == d and step) or (residual >= best / 2 and residual <= 100 * tolerance):
            return values[:count][wanted], q[:, :count][:, wanted]
        best = min(best, residual)
        # Chebyshev recurrence on [0, cut], scaled so that the largest value keeps its size
        centre = half = max(values[-1], 1e-12 * trace) / 2
        sigma = first = half / (values[0] - centre) if values[0] > 2 * half else 0.5
        older, newer = q, (vq - centre * q) * (sigma / half)
        for _ in range(degree - 1 if width < d else 0):
            following = 1 / (2 / first - sigma)
            older, newer = newer, (covariance_pass(fit, mean, n, newer) - centre * newer) * (2 * following / half) - sigma * following * older
            sigma = following
        q = np.linalg.qr(newer if width < d else q)[0]
    raise RuntimeError(f"components are not certified: residual {best:g}")


def whiten(rows: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, degree: int = DEGREE) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = rows.sparkSession
    whole = stored(whole_vectors(rows, scale, offset), "whole")
    lengths = whole.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    d = lengths.d
    whole = whole.where(F.size("x") == d)
    fit = stored(whole.select("x").distinct(), "fit")
    n = fit.count()
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    totals = [0] * d
    for r in sums:
        totals[r.i] = int(r.s)
    mean = np.array([s / n for s in totals])
    trace = _trace(fit, mean, n)
    if trace == 0:
        return spark.createDataFrame([], schema)
    values, vectors = leading_components(fit, mean, n, trace, components, degree)
    turn = vectors / np.sqrt(values)
    identity_error = float(np.abs(turn.T @ covariance_pass(fit, mean, n, turn) - np.eye(len(values))).max()) if len(values) else 0.0
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                x = matrix(b.column(1), np.int64)
                deviation = pa.array(deviations(x, n, totals), pa.int64())
                white = ((x - mean) @ turn).ravel()
                rows_of = pa.array(np.repeat(np.arange(b.num_rows), k))
                fixed = lambda v, kind: pa.array(np.full(len(white), v), kind)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(rows_of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), fixed(n, pa.int64()), deviation.take(rows_of), pa.array(white),
                        pa.array(np.tile(values / trace, b.num_rows)), fixed(identity_error, pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return whole.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)


def deviations(x: np.ndarray, n: int, totals: list[int]) -> np.ndarray | list[int | None]:
    """Sums over dimensions of (n * x - total) ** 2, exact; None beyond a long. In longs where all on the way fits them."""
    most = max(map(abs, totals), default=0)
    if n * float(np.abs(x).max(initial=0)) < 2.0**62 and most < 2**62:
        off = n * x - np.array(totals, np.int64)
        if len(totals) * float(np.abs(off).max(initial=0)) ** 2 < 2.0**62:
            return (off**2).sum(axis=1)
    sums = (sum((n * v - s) ** 2 for v, s in zip(r, totals)) for r in x.tolist())
    return [v if v < 2**63 else None for v in sums]


def _trace(fit: DataFrame, mean: np.ndarray, n: int) -> float:
    """The sum of all eigenvalues: of the centred squares, without a product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if b.num_rows:
                total += float(((matrix(b.column(0)) - mean) ** 2).sum())
        yield _matrix_rows(np.array([[total]]))

    return float(_summed(fit.select("x").mapInArrow(run, "i int, y array<double>"), 1)[0, 0]) / n
