"""Embedding whitening: the leading components of quantised vectors, each scaled to unit variance.

The covariance of the distinct vectors comes from two distributed passes (sums, then centred products), and only sums of the
size of a vector or of a square of it reach the driver. Its eigenvectors are found in single precision and corrected by the
iteration of Ogita and Aishima in extended precision ("Iterative refinement for symmetric eigenvalue decomposition", 2018, and
its second part, 2019): each round is a few matrix products and squares the error. Where eigenvalues lie too close for that, the
eigenvectors of a cluster are turned within their span by a small eigenproblem of its own, shifted by the cluster's mean.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegate.llm.conversations import pieces
from valuegate.llm.storage import table, written

SCALE = 256
COMPONENTS = 4
ROUNDS = 40
#: Partial matrices that are added up in one task before all are.
FOLD = 64
#: A component whose variance is a smaller share of the greatest than rounding leaves has none.
LEAST_SHARE = 1e-13


def _norm(a: np.ndarray) -> np.longdouble:
    return np.sqrt((a * a).sum())


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Indices of ``values`` that hang together by steps of at most ``gap``; only those of more than one."""
    order = np.argsort(values)
    cut = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [c for c in np.split(order, cut) if len(c) > 1]


def refined(a: np.ndarray, x: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the symmetric ``a`` from approximate eigenvectors ``x``, in extended precision."""
    a, x = a.astype(np.longdouble), x.astype(np.longdouble)
    n, size, eps = len(a), _norm(a), np.finfo(np.float64).eps
    values, turned, last = np.diag(a).copy(), False, np.inf
    if not size:
        return np.zeros(n, np.longdouble), np.eye(n, dtype=np.longdouble)
    for _ in range(rounds):
        r = np.eye(n, dtype=np.longdouble) - x.T @ x
        s = x.T @ (a @ x)
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        gap = 2 * (_norm(s - np.diag(values)) + size * _norm(r))
        apart = values[None, :] - values[:, None]
        near = np.abs(apart) <= gap
        e = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, apart))
        x = x + x @ e
        change = np.abs(e).max()
        clusters = _clusters(values, gap)
        # Settled: the basis is orthonormal, what is still in clusters has been turned within them, and the corrections are
        # nothing or no longer shrink (between eigenvalues that differ by little more than rounding, they never vanish).
        if np.abs(r).max() <= eps / 16 and (turned or not clusters) and (change <= eps / 16 or change >= last / 2):
            break
        last = change
        turned = bool(clusters) and change <= np.sqrt(eps)
        for c in clusters if turned else ():
            q = x[:, c]
            shift = values[c].mean()
            small = q.T @ (a @ q) - shift * (q.T @ q)
            small = (small + small.T) / 2
            scale = np.abs(small).max()
            if scale > size * np.finfo(np.longdouble).eps * n:  # else its eigenvalues are equal, and any basis will do
                _, w = np.linalg.eigh((small / scale).astype(np.float64))
                x[:, c] = q @ w.astype(np.longdouble)
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix, to double precision."""
    scale = np.abs(a).max() if a.size else 0
    start = np.linalg.eigh((a / scale if scale else a).astype(np.float32))[1]
    values, x = refined(a, start)
    return values.astype(np.float64), (x / np.sqrt((x * x).sum(axis=0))).astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """What the distinct vectors gave: count and sums (exact), and per component its direction, variance and share."""

    n: int
    sums: tuple[int, ...]
    directions: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors without null, non-finite or oversized entries, as whole numbers floor(scale * entry).

    An entry of which that is no 64-bit number counts as not finite. Empty vectors go.
    """
    limit = float(1 << 62)
    scaled = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale))
    # A comparison with a null gives null and one with NaN is false below: NaN is greater than every number.
    fine = F.coalesce(F.forall("embedding", lambda c: F.abs(c.cast("double") * scale) < limit), F.lit(False)) & F.forall("embedding", lambda c: c.isNotNull())
    return vectors.filter((F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in (piece for b in batches if b.num_rows for piece in pieces(b)):
        yield batch, _matrix(batch.column("x"), width)


def _added(partial: DataFrame) -> np.ndarray:
    """The sum of partial matrices given as rows (row, task, part: array<double>): folded twice in tasks, then read, of a matrix's size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            own = _matrix(batch.column("part"), len(batch.column("part")[0])).sum(axis=0)
            total, row, task = own if total is None else total + own, batch.column("row")[0], batch.column("task")[0]
        yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int32()), pa.array([task.as_py() % FOLD], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], ["row", "task", "part"])

    kind = "row int, task int, part array<double>"
    folded = partial.groupBy("row", F.pmod("task", F.lit(FOLD)).alias("some")).applyInArrow(add, kind)
    rows = folded.groupBy("row").applyInArrow(add, kind).collect()
    return np.array([r["part"] for r in sorted(rows, key=lambda r: r["row"])])


def _covariance(vectors: DataFrame, centre: np.ndarray, by: np.ndarray | None, n: int) -> np.ndarray:
    """Covariance of ``(x - centre) @ by`` over all rows; centred, and for ``by`` centred again by its own mean, before multiplying."""
    width = len(centre)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _matrices(batches, width):
            y = x - centre
            y = y if by is None else y @ by
            own = y.T @ y
            total = own if total is None else total + own
        if total is not None:
            d = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, TaskContext.get().partitionId()), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["row", "task", "part"])

    total = _added(vectors.select("x").mapInArrow(products, "row int, task int, part array<double>"))
    total = (total + total.T) / 2
    return total / n


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of quantised ``vectors`` (x), each distinct one counted once; None if there are none.

    Vectors of another length than the most frequent one (the longest of those equally frequent) are left out. The distinct
    vectors are written once and read three times; the driver gets sums of a vector's length and two small matrices.
    """
    lengths = vectors.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not lengths:
        return None
    width = lengths["d"]
    distinct = written(vectors.filter(F.size("x") == width).select("x").distinct(), "distinct-vectors")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = 0, np.zeros(width, object)
        for batch, x in _matrices(batches, width):
            count += batch.num_rows
            # High and low halves are added apart, so that no sum leaves 64 bits.
            total = total + (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int32()), pa.array([str(v) for v in (*total.tolist(), count)])], ["at", "part"])

    exact = distinct.mapInArrow(sums, "at int, part string").groupBy("at").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total")).collect()
    by = {r["at"]: int(r["total"]) for r in exact}
    n, total = by[width], tuple(by[k] for k in range(width))
    centre = np.array([float(s / n) for s in total])
    covariance = _covariance(distinct, centre, None, n)
    values, directions = eigen(covariance)
    trace, k = float(np.trace(covariance)), min(components, width)
    known = values[:k] > LEAST_SHARE * max(trace, 0)
    values = np.where(known, values[:k], np.nan)
    model = Whitening(n, total, directions[:, :k], values, values / trace if trace > 0 else values)
    error = None
    if known.any():
        scaled = directions[:, :k][:, known] / np.sqrt(values[known])
        error = float(np.abs(_covariance(distinct, centre, scaled, n) - np.eye(int(known.sum()))).max())
    return Whitening(model.n, model.sums, model.directions, model.variances, model.explained, error)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Per row the exact sum of (n * x - S)^2; null where it is no 64-bit number."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums)) if x.size else 0
    if most * most * x.shape[1] < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """One row for each quantised vector and component. Narrow.

    A component without variance has null for ``whitened`` and ``explained``. Repeated rows and ids give their rows again.
    """
    width, k = len(model.sums), model.directions.shape[1]
    centre = np.array([float(s / model.n) for s in model.sums])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _matrices(batches, width):
            # Rows are projected one by one by the same sums, so equal vectors get equal values in any batch.
            y = np.stack([((x - centre) * model.directions[:, c]).sum(axis=1) / np.sqrt(model.variances[c]) for c in range(k)], axis=1)
            each, rows = np.repeat(np.arange(len(x)), k), len(x)
            explained = np.tile(model.explained, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, model.n), pa.int64()),
                    pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(each)), pa.array(y.reshape(-1), from_pandas=True), pa.array(explained, from_pandas=True),
                    pa.array([model.identity_error] * (rows * k), pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.filter(F.size("x") == width).select("vec_id", "x").mapInArrow(project, ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    model = fit(vectors)
    return whiten(vectors, model) if model else spark.createDataFrame([], ROWS)
