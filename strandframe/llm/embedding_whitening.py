"""Embedding whitening (operator 12): covariances by Chan merging, principal components, whitened coordinates.

Every entry becomes a whole number first, so sums are exact. A partition condenses its vectors to a count,
sums and the scatter around its own mean; two such states merge by Chan's formula, pairwise in treeReduce,
so nothing is ever squared before it is centred and the driver gets one state. A second pass whitens all
vectors and condenses these in the same way: how far their covariance is from the identity is measured,
not assumed.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare

SCALE, SHIFT, MOST = 64.0, 1_000_000, 32
#: Values that a slice of a batch holds at the most while it is worked on.
SLICE = 1 << 20


@dataclass
class Moments:
    """Count, sums (exact for whole numbers) and scatter around the mean of vectors of one length."""

    n: int
    total: np.ndarray
    scatter: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        """Of the rows of ``x``, whole numbers or doubles; centred before they are multiplied."""
        total = x.sum(axis=0)
        d = x - total / len(x)
        d -= d.mean(axis=0)  # what the mean's own rounding left
        return cls(len(x), total.astype(object) if x.dtype.kind == "i" else total, d.T @ d)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula: scatters add up, and the means' distance counts n m / (n + m) times."""
        n = self.n + other.n
        if self.total.dtype == object:  # exact up to the division
            apart = ((other.total * self.n - self.total * other.n) / (self.n * other.n)).astype(float)
        else:
            apart = other.total / other.n - self.total / self.n
        return Moments(n, self.total + other.total, self.scatter + other.scatter + np.outer(apart, apart) * (self.n / n * other.n))


State = dict[int, Moments]  # by length of the vectors


def _merge(a: State, b: State) -> State:
    return a | {k: a[k].merged(m) if k in a else m for k, m in b.items()}


@dataclass(frozen=True)
class Fit:
    """What whitens vectors of one length: ``axes`` are the components' unit vectors, one a column."""

    n: int
    total: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float

    @classmethod
    def of(cls, m: Moments, most: int) -> Fit:
        v = m.scatter / m.n
        values, axes = np.linalg.eigh((v + v.T) / 2)
        values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
        # the largest entry of a component is positive, so that reruns agree
        axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        return cls(m.n, m.total, values, axes, float(np.trace(v)))

    @property
    def usable(self) -> np.ndarray:
        """Components with variance beyond rounding; there is nothing to whiten along the others."""
        return self.values > len(self.total) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        whole = self.total // self.n  # the mean in two parts, so that no digit of it is lost
        part = ((self.total - whole * self.n) / self.n).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = ((x - whole.astype(np.int64)) - part) @ self.axes / np.sqrt(self.values)
        return np.where(self.usable, y, np.nan)


def _vectors(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``rows, x`` of the usable vectors of each length, in slices: row numbers and whole numbers."""
    held = batch.column(column)
    lengths = np.where(np.asarray(held.is_null()), 0, held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = held.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == length)
        step = max(1, SLICE // int(length))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            c = flat[starts[some][:, None] + np.arange(length)]
            good = np.isfinite(c).all(axis=1)
            if good.any():
                yield some[good], np.floor(SCALE * c[good]).astype(np.int64) + SHIFT


def moments(rows: DataFrame, vector: str = "embedding", fits: dict[int, Fit] | None = None) -> State:
    """The merged state of all usable vectors; with ``fits`` that of the whitened ones, without components of no variance.

    A partition gives one row, its state; these are merged pairwise by treeReduce.
    """
    spark = rows.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(fits) if fits is not None else None  # components and sums only: most x length doubles

    def condense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: State = {}
        for batch in batches:
            for _, x in _vectors(batch, 0):
                length = x.shape[1]
                if shared is not None:
                    fit = shared.value[length]
                    x = fit.whitened(x)[:, fit.usable]
                state = _merge(state, {length: Moments.of(x)})
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = rows.select(F.col(vector)).mapInArrow(condense, "state binary").rdd.map(lambda r: pickle.loads(r.state))
    return states.treeReduce(_merge, depth=3) if states.getNumPartitions() else {}


def fit(rows: DataFrame, vector: str = "embedding", most: int = MOST) -> dict[int, Fit]:
    """What whitens the vectors of ``rows``, by length. The driver decomposes a matrix of length times length."""
    return {length: Fit.of(m, most) for length, m in moments(rows, vector).items()}


def identity_error(rows: DataFrame, fits: dict[int, Fit], vector: str = "embedding") -> float | None:
    """The largest entry of the whitened vectors' covariance less the identity, over all of them; null if there is no variance."""
    errors = [float(np.abs(m.scatter / m.n - np.eye(len(m.scatter))).max()) for m in moments(rows, vector, fits).values() if len(m.scatter)]
    return max(errors, default=None)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: a row for each vector and component up to ``most``.

    Vectors that are null, empty or hold a null or a number that is not finite take no part. Vectors of
    another length are a space of their own. ``deviation`` is exact, null where it does not fit a long.
    ``whitened`` is null for components without variance (of equal vectors, say), ``explained`` if there is
    none at all. Repeated rows and null ids count and come back as they are; an empty table gives no rows.
    """
    fits = fit(rows, vector, most)
    error = identity_error(rows, fits, vector)
    shared = rows.sparkSession.sparkContext.broadcast(fits)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _vectors(batch, 1):
                f: Fit = shared.value[x.shape[1]]
                k = len(f.values)
                apart = (f.n * x - f.total.astype(np.int64)) if f.n * int(np.abs(x).max()) < 1 << 62 else (f.n * x.astype(object) - f.total)
                fits_long = np.square(apart.astype(float)).sum(axis=1) < 2.0**62
                deviation = np.where(fits_long, np.square(np.where(fits_long[:, None], apart, 0).astype(np.int64)).sum(axis=1), 0)
                many = lambda a: np.repeat(a, k)
                explained = np.tile(f.values / f.trace if f.trace > 0 else np.full(k, np.nan), len(at))
                for low in range(0, len(at), max(1, SLICE // max(k, 1))):
                    part = slice(low, low + max(1, SLICE // max(k, 1)))
                    m = len(at[part])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(many(at[part]))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)),
                            pa.array(many(deviation[part]), mask=many(~fits_long[part])), pa.array(f.whitened(x[part]).ravel(), from_pandas=True), pa.array(explained[: m * k], from_pandas=True),
                        ],
                        names=[key, "component", "n", "deviation", "whitened", "explained"],
                    )

    out = rows.select(key, F.col(vector)).mapInArrow(run, f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double")
    return out.withColumn("identity_error", F.lit(error).cast("double"))
