"""Whitening of embeddings by matrix-free block subspace iteration.

Entries are counted in 64ths, as whole numbers about ``OFFSET``, so sums are exact. A pass over the rows
gives their number and sums; each further one gives V Q = Xᵀ(X Q) / n for a block Q of ``2 k`` columns at
most, where X are the rows less their mean and V, their covariance, is never formed. Partitions add up their
products and emit one row for each cell of the block; Spark adds those, so the driver gets one block however
many rows there are. There the block is made orthonormal again (QR), and a Rayleigh-Ritz step inside it gives
the components and their residuals |V q - e q|. Passes go on until all k residuals are below
``RESIDUAL`` of the greatest eigenvalue. After ``PASSES`` without that, the block is doubled: a flat
spectrum converges slowly, and a block as wide as the vectors needs one pass. One more pass measures the
covariance of what is returned.

Memory: a block of the vectors' dimension times 2 k doubles (or up to the dimension squared) in each task
and on the driver, and a batch of rows.

Defined cases: rows whose vector is null or has null, infinite or NaN entries are dropped; so are rows of
another length than most have (of the longest of these lengths, if several are as frequent) and empty ones;
entries beyond 2**40 in size count as 2**40; components whose eigenvalue is not above rounding (constant or
dependent columns, one row) can't be whitened and are left out, so there may be fewer than k, or no row at all;
equal eigenvalues share a space, of which any base may be returned; ``deviation`` is null where it passes a
long; repeated rows and null ids are rows like others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**40
RESIDUAL = 1e-12
PASSES = 8
SEED = 5
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole_rows(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vector) of the rows that count, and the length of their vectors (0 if there are none)."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vector IS NOT NULL").filter(~bad)
    lengths = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).filter("d > 0")
    top = lengths.agg(F.max(F.struct("n", "d")).alias("top")).first()["top"]
    return rows.filter(F.size("vector") == F.lit(top["d"] if top else -1)), top["d"] if top else 0


def counted(column: pa.ListArray, d: int) -> np.ndarray:
    """Rows of whole numbers: floor(64 c) + OFFSET."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * values), -LARGEST, LARGEST).astype(np.int64) + OFFSET


class Centre:
    """Number of rows and sums of each dimension; rows less their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n x - S; of Python numbers where a long can't hold it."""
        near = x - self.floor
        if near.size and int(np.abs(near).max()) >= (1 << 62) // self.n:
            return near.astype(object) * self.n - self.rest.astype(object)
        return near * self.n - self.rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.scaled(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)**2."""
        t = self.scaled(x)
        if t.dtype == object or t.size and float(np.abs(t).max()) ** 2 * t.shape[1] >= 2.0**62:
            exact = [sum(int(v) ** 2 for v in row) for row in t]
            return [v if v < 1 << 63 else None for v in exact]
        return (t * t).sum(axis=1).tolist()


def summed(rows: DataFrame, of_batch: Callable[[np.ndarray], np.ndarray], d: int, size: int, kind: str) -> np.ndarray:
    """The sum of ``of_batch`` (an array of ``size`` numbers for a batch of vectors) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = of_batch(counted(batch.column(0), d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    cells = rows.select("vector").mapInArrow(run, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in cells:
        out[r["cell"]] = r["value"]
    return out


def centre_of(rows: DataFrame, d: int) -> Centre | None:
    found = summed(rows, lambda x: np.append(x.sum(axis=0), len(x)), d, d + 1, "long").tolist()
    return Centre(found[-1], found[:-1]) if found[-1] else None


def product(rows: DataFrame, centre: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """V q, and the trace of V: one pass."""
    d, b = q.shape

    def of_batch(x: np.ndarray) -> np.ndarray:
        c = centre.rows(x)
        return np.append((c.T @ (c @ q)).ravel(), (c * c).sum())

    found = summed(rows, of_batch, d, d * b + 1, "double") / centre.n
    return found[:-1].reshape(d, b), float(found[-1])


def components(rows: DataFrame, centre: Centre, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues from the greatest down, unit eigenvectors as columns, and the trace: k of them, or as many as are above rounding."""
    d, rng = len(centre.sums), np.random.default_rng(SEED)
    width, passes = min(d, 2 * k), 0
    q = np.linalg.qr(rng.normal(size=(d, width)))[0]
    while True:
        y, trace = product(rows, centre, q)
        h = q.T @ y
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        residuals = np.linalg.norm(y @ turn - (q @ turn) * values, axis=0)[:k]
        passes += 1
        if width == d or (residuals <= RESIDUAL * max(values[0], 0.0)).all():
            some = values[:k] > max(values[0], 0.0) * d * np.finfo(float).eps * 8
            return values[:k][some], (q @ turn)[:, :k][:, some], trace
        if passes % PASSES == 0:
            width = min(d, 2 * width)
        q = np.linalg.qr(np.hstack([y @ turn, rng.normal(size=(d, width - y.shape[1]))]))[0]


def identity_error(rows: DataFrame, centre: Centre, whitening: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    d, k = whitening.shape

    def of_batch(x: np.ndarray) -> np.ndarray:
        w = centre.rows(x) @ whitening
        return np.append((w.T @ w).ravel(), w.sum(axis=0))

    found = summed(rows, of_batch, d, k * k + k, "double") / centre.n
    mean = found[k * k :]
    return float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    rows, d = whole_rows(vectors, id_col, vector_col)
    centre = centre_of(rows, d) if d else None
    values, vectors_, trace = components(rows, centre, min(k, d)) if centre else (np.zeros(0), None, 0.0)
    if not len(values):
        return spark.createDataFrame([], SCHEMA)
    whitening, many = vectors_ / np.sqrt(values), len(values)
    error, explained = identity_error(rows, centre, whitening), values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = counted(batch.column(1), d)
            at = pa.array(np.repeat(np.arange(n), many))
            ids, deviations = batch.column(0).take(at), pa.array(centre.deviations(x), pa.int64()).take(at)
            columns = [
                ids, pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), n)), pa.array(np.full(n * many, centre.n)), deviations,
                pa.array((centre.rows(x) @ whitening).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * many, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
