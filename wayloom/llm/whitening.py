"""Whitening of vectors: moments by Welford's updates inside partitions, merged in a tree, and an eigen-solve by symmetric QR."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm.common import batched, cut, table

COMPONENTS = 32
#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Partial results that are merged in one task.
FAN = 16
#: Entries whose scaled value no long holds count as infinite.
_LARGEST = 2.0**62


class Moments:
    """Number, mean and sum of centred products of vectors of one length, and their exact sum.

    Vectors are held less the first one (origin), which loses nothing as they are integers, and keeps the products small."""

    def __init__(self, origin: np.ndarray):
        d = len(origin)
        self.n, self.origin, self.mean, self.products, self.sums = 0, origin, np.zeros(d), np.zeros((d, d)), [0] * d

    def add(self, rows: np.ndarray) -> None:
        """Welford: each vector is an update of rank one."""
        for x in (rows - self.origin).astype(np.float64):
            self.n += 1
            off = x - self.mean
            self.mean += off / self.n
            self.products += off[:, None] * (x - self.mean)
        if rows.dtype == np.int64:
            high, low = (rows >> 32).sum(axis=0).tolist(), (rows & 0xFFFFFFFF).sum(axis=0).tolist()
            self.sums = [s + (h << 32) + g for s, h, g in zip(self.sums, high, low)]

    def merge(self, other: Moments) -> None:
        n = self.n + other.n
        moved = other.mean + (other.origin - self.origin).astype(np.float64)  # the other's mean, from this origin
        off = moved - self.mean
        self.products += other.products + np.outer(off, off) * (self.n * other.n / n)
        self.mean += off * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums)]

    def covariance(self) -> np.ndarray:
        return (self.products + self.products.T) / (2 * self.n)

    def gaps(self) -> np.ndarray:
        """Sum / n - origin in double precision."""
        return np.array([float(s - self.n * int(o)) / self.n for s, o in zip(self.sums, self.origin)])


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, the entries beside it, q) by reflections: matrix = q t q'."""
    a, d = matrix.astype(np.float64).copy(), len(matrix)
    q = np.eye(d)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.sqrt(x @ x)
        if size == 0 or not x[1:].any():
            continue
        x[0] += math.copysign(size, x[0])
        x /= np.sqrt(x @ x)
        a[k + 1 :] -= 2 * np.outer(x, x @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns: implicit QR steps with Wilkinson's shift on its tridiagonal form."""
    d = len(matrix)
    diagonal, beside, q = tridiagonal(matrix)
    q, end = np.ascontiguousarray(q.T), d - 1  # eigenvectors as rows, which a rotation combines
    for _ in range(60 * d):
        for k in range(end):
            if abs(beside[k]) <= np.finfo(float).eps * (abs(diagonal[k]) + abs(diagonal[k + 1])):
                beside[k] = 0.0
        while end > 0 and beside[end - 1] == 0:
            end -= 1
        if end <= 0:
            break
        begin = end - 1
        while begin > 0 and beside[begin - 1] != 0:
            begin -= 1
        half = (diagonal[end - 1] - diagonal[end]) / 2
        b = beside[end - 1]
        shift = diagonal[end] - b * b / (half + math.copysign(math.hypot(half, b), half))
        x, z = diagonal[begin] - shift, beside[begin]
        for k in range(begin, end):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > begin:
                beside[k - 1] = r
            p, o, w = diagonal[k], diagonal[k + 1], beside[k]
            diagonal[k], diagonal[k + 1] = c * c * p + 2 * c * s * w + s * s * o, s * s * p - 2 * c * s * w + c * c * o
            beside[k] = (c * c - s * s) * w + c * s * (o - p)
            if k < end - 1:
                z, x = s * beside[k + 1], beside[k]
                beside[k + 1] *= c
            q[k : k + 2] = np.array([[c, s], [-s, c]]) @ q[k : k + 2]
    else:
        raise ArithmeticError("no convergence")
    order = np.argsort(-diagonal, kind="stable")
    vectors = q[order].T
    return diagonal[order], vectors / np.sqrt((vectors * vectors).sum(axis=0))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, vectors as rows) of each length in a batch."""
    ids, vectors = batch.column("vec_id"), batch.column("embedding")
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        some = pa.array(np.flatnonzero(lengths == d))
        part = vectors.take(some)
        yield ids.take(some), part.flatten().to_numpy(zero_copy_only=False).reshape(len(some), d)


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors.astype(np.float64)).astype(np.int64) + OFFSET


def _merged(parts: DataFrame) -> dict[int, Moments]:
    """parts(d, moments) -> the moments of each length: merged by FAN in tasks, level by level, until there is a row a length."""
    schema = "d int, at long, moments binary"

    def merge(frame):
        import pandas as pd

        total = None
        for raw in frame.sort_values("at")["moments"]:
            one = pickle.loads(raw)
            if total is None:
                total = one
            else:
                total.merge(one)
        return pd.DataFrame({"d": [frame["d"].iloc[0]], "at": [frame["at"].iloc[0] // FAN], "moments": [pickle.dumps(total)]})

    level = cut(parts)
    while level.agg(F.max("at")).first()[0]:
        level = cut(level.groupBy("d", F.expr(f"at div {FAN}")).applyInPandas(merge, schema))
    # a row a length; parts of one length and place are left only where a task gave several
    return {r["d"]: pickle.loads(r["moments"]) for r in level.groupBy("d").applyInPandas(merge, schema).collect()}


def _moments(good: DataFrame, made) -> dict[int, Moments]:
    """Moments of made(d, vectors) over all rows of good."""

    def run(batches):
        from pyspark import TaskContext

        found: dict[int, Moments] = {}
        for batch in batches:
            for _, vectors in _by_length(batch):
                d, rows = vectors.shape[1], made(vectors)
                if d not in found:
                    found[d] = Moments(rows[0].copy() if rows.dtype == np.int64 else np.zeros(rows.shape[1]))
                found[d].add(rows)
        at = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([at] * len(found), pa.int64()), pa.array([pickle.dumps(m) for m in found.values()], pa.binary())], names=["d", "at", "moments"])

    return _merged(batched(good).mapInArrow(run, "d int, at long, moments binary"))


class Whitener:
    """What vectors of one length are whitened by."""

    def __init__(self, moments: Moments, components: int):
        values, vectors = eigen(moments.covariance())
        trace = float(np.trace(moments.covariance()))
        self.n, self.sums, self.origin, self.gaps = moments.n, moments.sums, moments.origin, moments.gaps()
        k = min(components, len(values))
        usable = values[:k] > len(values) * np.finfo(float).eps * max(values[0], 0.0)
        self.scales = np.where(usable, 1 / np.sqrt(np.where(usable, values[:k], 1.0)), np.nan)
        self.vectors, self.explained = vectors[:, :k], np.where(usable, values[:k], 0.0) / (trace or 1.0)
        self.identity_error = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The components of rows of scaled vectors; not a number where a component has no spread."""
        return (((x - self.origin).astype(np.float64) - self.gaps) @ self.vectors) * self.scales

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2; None where no long holds it."""
        off = [[self.n * int(self.origin[j]) - s for j, s in enumerate(self.sums)]]
        y = x - self.origin
        most = self.n * int(np.abs(y).max(initial=0)) + max((abs(o) for o in off[0]), default=0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            z = self.n * y + np.array(off, dtype=np.int64)
            return (z * z).sum(axis=1).tolist()
        out = [sum((self.n * v + o) ** 2 for v, o in zip(row, off[0])) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is not empty and holds finite entries alone."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < _LARGEST)
    return vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine))


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, component, n, deviation, whitened, explained, identity_error: a row a vector and component.

    Rows whose embedding is null or empty, or holds null, NaN or infinite entries (or such as no long holds after scaling), are dropped. Vectors of
    each length are whitened among themselves; lengths are taken to be few, as a model a length (d x d numbers) comes to the driver and to the tasks.
    A component without spread (an eigenvalue of 0 up to rounding) is null in whitened and takes no part in identity_error. deviation is null where no
    long holds it. Repeated rows and null ids are rows like others; other columns are ignored; an empty table gives no rows."""
    good = usable(vectors.select("vec_id", "embedding"))
    models = {d: Whitener(m, components) for d, m in _moments(good, scaled).items()}
    # measured on the whitened vectors themselves, by one more pass
    for d, m in _moments(good, lambda v: np.nan_to_num(models[v.shape[1]].apply(scaled(v)))).items():
        some = np.flatnonzero(~np.isnan(models[d].scales))
        if len(some):
            models[d].identity_error = float(np.abs(m.covariance()[np.ix_(some, some)] - np.eye(len(some))).max())

    def run(batches):
        for batch in batches:
            for ids, found in _by_length(batch):
                model, x = models[found.shape[1]], scaled(found)
                k = len(model.scales)
                for at in range(0, len(x), max(1, 65536 // k)):
                    part = x[at : at + max(1, 65536 // k)]
                    rows = len(part)
                    values = model.apply(part).ravel()
                    again = pa.array(np.repeat(np.arange(at, at + rows), k))
                    columns = [
                        ids.take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, model.n, dtype=np.int64)),
                        pa.array(model.deviations(part), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))), pa.array(values, mask=np.isnan(values)),
                        pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, model.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return batched(good).mapInArrow(run, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
