"""Whitening of embeddings: centred, projected on principal components, scaled to unit variance.

Entries become integers floor(256 * c). The distinct vectors are written once; over them each task
computes its count, mean and centred scatter, Chan's formula merges pairs of these in a treeReduce,
and the driver takes the eigenvectors of one matrix of dimensions squared. A second pass over the
same vectors merges the scatter of the whitened ones and compares it with the identity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, saved

#: Vectors that one step of a task holds as a matrix.
STEP = 4096
#: Entries that 256 times a value must stay below, so that they and their differences are longs.
LARGEST = 2.0**52


def as_integers(vector: Column) -> Column:
    """floor(256 * c) of every entry; null if the vector is null or empty, or an entry is null, not
    finite or of a size of 2**44 or more."""
    doubles = F.transform(vector, lambda c: c.cast("double") * 256)
    fine = F.forall(doubles, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.when((F.size(vector) > 0) & fine, F.transform(doubles, lambda c: F.floor(c).cast("long")))


def matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of rows and their vectors, all of one length, as a matrix of longs."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            part = batch.slice(at, STEP)
            flat = part.column(part.schema.get_field_index(column)).flatten()
            yield part, np.asarray(flat).reshape(part.num_rows, -1)


@dataclass
class Moments:
    """Count, mean and centred scatter of vectors, and their exact sums."""

    n: int
    mean: np.ndarray
    scatter: np.ndarray
    sums: list[int]

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0, dtype=np.float64)
        centred = x - mean
        exact = x.dtype.kind == "i"
        # halves of 26 bits, so that sums over a step stay longs
        sums = [(int(high) << 26) + int(low) for high, low in zip((x >> 26).sum(axis=0), (x & (2**26 - 1)).sum(axis=0), strict=True)] if exact else []
        return cls(len(x), mean, centred.T @ centred, sums)

    def merged(self, other: Moments) -> Moments:
        """Chan's formula. The difference of the means comes from the exact sums where there are any."""
        n = self.n + other.n
        shift = other.mean - self.mean
        if self.sums:
            shift = np.array([(b * self.n - a * other.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        scatter = self.scatter + other.scatter + np.outer(shift, shift) * (self.n / n * other.n)
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        return Moments(n, self.mean + shift * (other.n / n), scatter, sums)


def moments(vectors: DataFrame, transform=None) -> Moments | None:
    """Of all vectors x, or of what ``transform`` makes of a matrix of them; None if there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for _, x in matrices(batches):
            if len(x):
                step = Moments.of(x if transform is None else transform(x))
                own = step if own is None else own.merged(step)
        if own is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([own.n], pa.int64()), pa.array([own.mean.tobytes()], pa.binary()), pa.array([own.scatter.tobytes()], pa.binary()), pa.array([[str(s) for s in own.sums]], pa.list_(pa.string()))],
                names=["n", "mean", "scatter", "sums"],
            )

    def read(row) -> Moments:
        mean = np.frombuffer(row.mean)
        return Moments(row.n, mean, np.frombuffer(row.scatter).reshape(len(mean), len(mean)), [int(s) for s in row.sums])

    if vectors.isEmpty():
        return None
    parts = vectors.select("x").mapInArrow(run, "n long, mean binary, scatter binary, sums array<string>")
    return parts.rdd.map(read).treeReduce(Moments.merged)


@dataclass
class Whitening:
    """n vectors with exact sums; columns of ``matrix`` project a centred vector on a component and
    scale it to unit variance. ``explained``: each component's share of the variance. A component
    without variance has a column of NaN."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)**2, exact; None where that is no long."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, 1) + max(map(abs, self.sums), default=0)
        if most * most * len(self.sums) < 2**63:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x.tolist()]
        return [d if d < 2**63 else None for d in exact]


def fit_whitening(vectors: DataFrame, components: int = 4) -> Whitening | None:
    """Fits on the vectors x, each once; a second pass measures how far the whitened ones' covariance
    is from the identity, over the components with variance. None for no vector."""
    whole = moments(vectors)
    if whole is None:
        return None
    covariance = whole.scatter / whole.n
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    values, axes, trace = np.maximum(values[order], 0), axes[:, order], np.trace(covariance)
    usable = values > len(covariance) * np.finfo(float).eps * max(values.max(initial=0), np.finfo(float).tiny)
    scale = np.where(usable, 1 / np.sqrt(np.where(usable, values, 1)), np.nan)
    explained = values / trace if trace > 0 else np.zeros(len(values))
    # signs are free: the largest entry of each component is made positive, so that reruns agree
    signs = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    out = Whitening(whole.n, whole.sums, axes * signs * scale, explained, 0.0)
    if usable.any():
        fitted = out.matrix[:, usable]
        second = moments(vectors, lambda x: (x - out.mean) @ fitted)
        out.identity_error = float(np.abs(second.scatter / second.n - np.eye(int(usable.sum()))).max())
    return out


def whitened(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: a row for each vector and
    each of its first ``components`` components.

    Rows whose vector is null or empty, or holds a null or non-finite entry or one of a size of
    2**44 or more, are dropped, as are those of another length than most (of the longest of such
    lengths). Repeated rows all come back, but are fitted on once, as are equal vectors. A component
    without variance has a null ``whitened``; a deviation that no long holds is null. Extra columns
    are not read; no usable vector gives an empty table.
    """
    rows = embeddings.select(F.col(f"`{vec_id}`").alias("vec_id"), as_integers(F.col(f"`{vector}`")).alias("x")).where("x IS NOT NULL")
    lengths = rows.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("times")).orderBy(F.desc("times"), F.desc("size")).limit(1).collect()
    schema = rows.select("vec_id").schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double")
    if not lengths:
        return embeddings.sparkSession.createDataFrame([], schema)
    rows = rows.where(F.size("x") == lengths[0]["size"])
    distinct = saved(rows.select("x").distinct())
    fitted = fit_whitening(distinct, components)
    discard(distinct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = fitted.matrix.shape[1]
        for part, x in matrices(batches):
            n = part.num_rows
            values = fitted.whiten(x).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * k, fitted.n, np.int64)), pa.array([d for d in fitted.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(values, mask=np.isnan(values)), pa.array(np.tile(fitted.explained, n)), pa.array(np.full(n * k, fitted.identity_error)),
                ],
                names=schema.names,
            )

    return rows.mapInArrow(run, schema)
