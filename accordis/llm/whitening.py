"""Whitening of embeddings by a singular value decomposition that never forms the covariance.

Components are scaled to whole numbers, x = floor(256 c). The fit list, each distinct x-vector once, is centred on its mean and
compressed block by block: a task stacks the triangular factor R that it has on the next block and factors again (TSQR),
so of any number of vectors one R of d x d numbers is left a task; factors are stacked FAN at a time until one is left. One-sided
Jacobi then rotates pairs of R's columns until all are orthogonal. The rotations, accumulated, are the components, and the
columns' lengths are the standard deviations times the root of n, accurate even where squaring would have lost them.

Only R (d * d doubles, 134 MB for 4,096 dimensions) comes to the driver. Sums and n are exact integers.

Defined results: a vector that is null, or holds null or a non-finite entry, is left out, as is one of another length than the
commonest (of equally common ones the longer); a null vec_id stays; repeated rows and rows with equal vectors are each given,
and count once in the fit; components whose deviation is zero up to rounding aren't given, so one distinct vector, or an
empty table, gives no rows; a deviation that doesn't fit 64 bits is null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, trimmed

#: Vectors that are factored at once, and factors that are stacked at once.
BLOCK, FAN = 4096, 16


@dataclass
class Whitening:
    """components: one a column, by falling deviation; variances: of x along them; sums over the n vectors of the fit list; trace of the covariance."""

    components: np.ndarray
    variances: np.ndarray
    sums: np.ndarray
    n: int
    trace: float
    identity_error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return ((x.astype(np.float64) - self.sums / self.n) @ self.components) / np.sqrt(self.variances)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S) ** 2 of each row, exact."""
        if x.size == 0:
            return [0] * len(x)
        widest = self.n * max(abs(int(x.max())), abs(int(x.min()))) + int(np.abs(self.sums).max())
        if widest * widest * x.shape[1] < 2**63:
            return ((self.n * x - self.sums) ** 2).sum(axis=1).tolist()
        exact = [sum((self.n * a - s) ** 2 for a, s in zip(row, self.sums.tolist(), strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]


def scaled(vectors: DataFrame, step: int = 256) -> DataFrame:
    """vec_id and x of the rows that take part."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("c", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull() & sound)
    return rows.select("vec_id", F.transform("c", lambda v: F.floor(v * step).cast("long")).alias("x"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, rotations): lengths of r @ rotations' orthogonal columns, falling. Pairs are dealt round-robin, so that disjoint ones turn together."""
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    order = np.argsort(-np.linalg.norm(a, axis=0), kind="stable")
    a, v = a[:, order], v[:, order]
    ring = np.arange(d + d % 2)  # an odd number of columns leaves one out each time
    small = np.finfo(np.float64).eps * np.sqrt(max(1, d))
    for _ in range(sweeps):
        turned = False
        for _ in range(len(ring) - 1):
            p, q = np.minimum(ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]), np.maximum(ring[: len(ring) // 2], ring[::-1][: len(ring) // 2])
            p, q = p[q < d], q[q < d]
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(axis=0), (aq * aq).sum(axis=0), (ap * aq).sum(axis=0)
            go = np.abs(gamma) > small * np.sqrt(alpha * beta)
            if go.any():
                turned = True
                p, q, ap, aq, alpha, beta, gamma = p[go], q[go], ap[:, go], aq[:, go], alpha[go], beta[go], gamma[go]
                with np.errstate(over="ignore"):  # an infinite cotangent is an angle of zero
                    zeta = (beta - alpha) / (2 * gamma)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                a[:, p], a[:, q] = c * ap - s * aq, s * ap + c * aq
                vp, vq = v[:, p], v[:, q]
                v[:, p], v[:, q] = c * vp - s * vq, s * vp + c * vq
            ring[1:] = np.roll(ring[1:], 1)
        if not turned:
            break
    lengths = np.linalg.norm(a, axis=0)
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order]


def totals(fitted: DataFrame) -> tuple[int, np.ndarray]:
    """How many x-vectors there are, and their exact sums. A task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, []
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if x.size:
                exact = x if abs(float(x.min())) + abs(float(x.max())) < 2**62 / len(x) else x.astype(object)
                part = exact.sum(axis=0).tolist()
                total = [a + b for a, b in zip(total, part, strict=True)] if total else part
                n += len(x)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int64()), pa.array([n, *total], pa.int64())], names=["i", "s"])

    found = fitted.mapInArrow(trimmed(run), "i long, s long").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    return (found[0]["s"] if found else 0), np.array([r["s"] for r in found[1:]], dtype=np.int64)


def triangle(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """R of the centred x-vectors of rows."""
    dim = len(mean)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for a in range(0, len(x), BLOCK):
                r = np.linalg.qr(np.vstack((r, x[a : a + BLOCK] - mean)), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["id", "r"])

    def stack(group: pa.Table) -> pa.Table:
        r = np.linalg.qr(np.vstack([np.frombuffer(b).reshape(-1, dim) for b in group.column("r").to_pylist()]), mode="r")
        return pa.table([pa.array([group.column("group")[0].as_py()], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["id", "r"])

    parts = materialize(rows.select("x").mapInArrow(trimmed(factor), "id long, r binary"))
    while (n := parts.count()) > 1:
        last, groups = parts, -(-n // FAN)
        places = F.pmod(F.col("id"), F.lit(groups)) if groups > 1 else F.lit(0).cast("long")
        parts = materialize(last.withColumn("group", places).groupBy("group").applyInArrow(stack, "id long, r binary"))
        release(last)
    found = parts.first()
    release(parts)
    return np.frombuffer(found["r"]).reshape(-1, dim) if found else np.zeros((0, dim))


def _identity_error(fitted: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list, less the identity."""
    dim, k = model.components.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, about = 0, np.zeros(k), np.zeros((k, k))  # about: products around the mean of what was read
        for batch in batches:
            w = model.apply(_matrix(batch.column(0), dim))
            if not len(w):
                continue
            step = w.mean(axis=0)
            off = w - step
            if n:
                apart = step - total / n
                about += np.outer(apart, apart) * (n * len(w) / (n + len(w)))
            about += off.T @ off
            n, total = n + len(w), total + w.sum(axis=0)
        if n:
            about += np.outer(total, total) / n
            i, j = np.indices((k, k)).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((i, np.full(k, -1)))), pa.array(np.concatenate((j, np.arange(k)))), pa.array(np.concatenate((about.ravel(), total)))], names=["i", "j", "v"])

    summed = fitted.select("x").mapInArrow(trimmed(run), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean, products = np.zeros(k), np.zeros((k, k))
    for r in summed:
        if r["i"] < 0:
            mean[r["j"]] = r["v"] / model.n
        else:
            products[r["i"], r["j"]] = r["v"]
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def fit(rows: DataFrame, most: int = 4) -> Whitening | None:
    """The whitening of scaled rows, all of one length, with up to `most` components; None without a component."""
    fitted = materialize(rows.select("x").distinct())
    n, total = totals(fitted)
    if not len(total):
        return None
    lengths, rotations = jacobi(triangle(fitted, total / n))
    real = lengths > (lengths[:1].max(initial=0.0) * np.finfo(np.float64).eps * max(n, len(total)) ** 0.5 * 4)
    kept = int(min(most, real.sum()))
    if not kept:
        return None
    components = rotations[:, :kept]
    components = components * np.where(components[np.abs(components).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    model = Whitening(np.ascontiguousarray(components), lengths[:kept] ** 2 / n, total, n, float((lengths**2).sum() / n))
    model.identity_error = _identity_error(fitted, model)
    release(fitted)
    return model


FIELDS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error for each row and component."""
    rows = scaled(vectors)
    commonest = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    rows = rows.filter(F.size("x") == (commonest["dim"] if commonest else 0))
    model = fit(rows, most) if commonest else None
    if model is None:
        return vectors.sparkSession.createDataFrame([], FIELDS)
    dim, k = model.components.shape
    explained = model.variances / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, size = _matrix(batch.column(1), dim), batch.num_rows
            deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(size), k)))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(size), k)))
            columns = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, model.n, np.int64)), deviation, pa.array(model.apply(x).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * k, model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in FIELDS.split(", ")])

    return rows.mapInArrow(trimmed(run), FIELDS)
