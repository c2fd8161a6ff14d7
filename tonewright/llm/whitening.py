"""Whitening of embeddings: streaming moments, merged across partitions, and eigenvectors.

Components become integers, floor(scale * c) + shift, so that sums are exact.

1. Every task streams its vectors through Welford's update: the mean moves by d / n, and the
   matrix of squared deviations grows by the rank-one product of the deviations before and
   after.  Sums per dimension are kept besides, as whole numbers.
2. States of tasks merge by the parallel update formula, in two levels of tasks; the driver
   gets one state per length of vectors, of that length squared.
3. The covariance is reduced to tridiagonal form by Householder reflections and diagonalised
   by symmetric QR steps with Wilkinson's shift, all in double precision.
4. Vectors are centred by exact integers, projected and scaled in one pass; the covariance of
   what came out is measured by a second run of the same streaming states.

Defined results: vectors that are null or hold null or non-finite entries are dropped; vectors
of each length are a fit of their own, with its own n (empty ones have no component and no
row); a component without variance (under 1e-12 of the trace) is null in `whitened`, and 0 in
`explained`; a deviation that no long can hold is null; entries beyond a fifth of a long's
range are held there; repeated rows and null ids are rows like others; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonewright.llm.shared import stored

STATE = "dim int, n long, mean binary, spread binary, sums array<string>"
_LONG = (1 << 63) - 1
_MOST = 1 << 61


class Moments:
    """Mean and squared deviations of a stream of vectors, and exact sums of whole ones."""

    def __init__(self, dim: int):
        self.n, self.mean, self.spread = 0, np.zeros(dim), np.zeros((dim, dim))
        self.sums = [0] * dim
        self._product = np.empty((dim, dim))

    def add(self, x: np.ndarray) -> None:
        """One vector: a rank-one update."""
        self.n += 1
        before = x - self.mean
        self.mean += before / self.n
        np.multiply(before[:, None], x - self.mean, out=self._product)
        self.spread += self._product

    def merge(self, n: int, mean: np.ndarray, spread: np.ndarray, sums: list[int]) -> None:
        """Another stream's state."""
        both = self.n + n
        if not n:
            return
        apart = mean - self.mean
        self.spread += spread + np.outer(apart, apart) * (self.n * n / both)
        self.mean += apart * (n / both)
        self.n = both
        self.sums = [a + b for a, b in zip(self.sums, sums, strict=True)]

    def covariance(self) -> np.ndarray:
        c = self.spread / max(self.n, 1)
        return (c + c.T) / 2

    @classmethod
    def batch(cls, states: dict[int, Moments]) -> pa.RecordBatch:
        dims = sorted(states)
        kept = [states[d] for d in dims]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(dims, pa.int32()),
                pa.array([s.n for s in kept], pa.int64()),
                pa.array([s.mean.astype("<f8").tobytes() for s in kept], pa.binary()),
                pa.array([s.spread.astype("<f8").tobytes() for s in kept], pa.binary()),
                pa.array([[str(x) for x in s.sums] for s in kept], pa.list_(pa.string())),
            ],
            names=["dim", "n", "mean", "spread", "sums"],
        )


def _merged(states: DataFrame, ways: int = 64) -> DataFrame:
    """One state per length, by two levels of merging tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for b in batches:
            for r in range(b.num_rows):
                dim = b.column(0)[r].as_py()
                mean, spread = (np.frombuffer(b.column(c)[r].as_py(), "<f8") for c in (2, 3))
                held.setdefault(dim, Moments(dim)).merge(b.column(1)[r].as_py(), mean, spread.reshape(dim, dim), [int(x) for x in b.column(4)[r].as_py()])
        if held:
            yield Moments.batch(held)

    return states.repartition(ways).mapInArrow(merge, STATE).repartition(1).mapInArrow(merge, STATE)


def rows_of(v: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of doubles) by length, of the vectors that have only finite entries."""
    flat = v.flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False)
    there = np.asarray(v.is_valid())
    sizes = np.where(there, np.asarray(v.value_lengths().fill_null(0)), 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    there &= bad[ends[1:]] == bad[ends[:-1]]
    for dim in np.unique(sizes[there]).tolist():
        rows = np.flatnonzero(there & (sizes == dim))
        if dim:
            yield rows, flat[ends[rows][:, None] + np.arange(dim)]


def whole_numbers(x: np.ndarray, scale: int, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * scale), -_MOST, _MOST).astype(np.int64) + shift


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and their unit eigenvectors (columns) of a symmetric matrix."""
    n = len(a)
    a, q = np.array(a, float), np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(float(np.linalg.norm(v)), v[0])
        length = float(np.linalg.norm(v))
        if not length:
            continue
        v /= length
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    d, e = np.diag(a).tolist(), np.diag(a, -1).tolist()
    q = np.ascontiguousarray(q.T)  # rotations work on rows
    eps = np.finfo(float).eps
    high = n - 1
    while high > 0:
        low = high
        while low > 0 and abs(e[low - 1]) > eps * (abs(d[low - 1]) + abs(d[low])):
            low -= 1
        if low > 0:
            e[low - 1] = 0.0
        if low == high:
            high -= 1
            continue
        # Wilkinson's shift: the eigenvalue of the last two by two block that is nearer its corner
        half, corner = (d[high - 1] - d[high]) / 2, e[high - 1]
        shift = d[high] - corner * corner / (half + math.copysign(math.hypot(half, corner), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, -z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k] = c * c * one - 2 * c * s * off + s * s * two
            d[k + 1] = s * s * one + 2 * c * s * off + c * c * two
            e[k] = c * s * (one - two) + (c * c - s * s) * off
            if k < high - 1:
                x, z = e[k], -s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] - s * q[k + 1], s * q[k] + c * q[k + 1]
    order = np.argsort(-np.array(d), kind="stable")
    vectors = q[order]
    return np.array(d)[order], (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T if n else q


@dataclass(frozen=True)
class Fit:
    """What whitening needs of one length of vectors."""

    n: int
    sums: list[int]
    axes: np.ndarray  # columns, each over the root of its eigenvalue; NaN without variance
    explained: list[float]

    @classmethod
    def of(cls, n: int, sums: list[int], covariance: np.ndarray, most: int) -> Fit:
        values, vectors = symmetric_qr(covariance)
        trace = float(np.trace(covariance))
        real = values[:most] > 1e-12 * trace
        with np.errstate(divide="ignore", invalid="ignore"):
            axes = np.where(real, vectors[:, :most] / np.sqrt(values[:most]), np.nan)
        return cls(n, sums, axes, [float(v / trace) if r else 0.0 for v, r in zip(values[:most].tolist(), real.tolist(), strict=True)])

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: whole numbers of Python where 64 bits may not hold them."""
        most = max(int(np.abs(x).max()), max(abs(s) for s in self.sums) // self.n + 1)
        if 2 * self.n * most < _LONG:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


def _deviations(apart: np.ndarray) -> list[int | None]:
    most = max((abs(int(v)) for v in (apart.max(), apart.min())), default=0) if apart.size else 0
    if most * most * apart.shape[1] > _LONG:
        apart = apart.astype(object)
    total = (apart * apart).sum(1).tolist()
    return [t if t <= _LONG else None for t in total]


def whiten(vectors: DataFrame, most: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Moments] = {}
        for b in batches:
            for _, values in rows_of(b.column(0)):
                x = whole_numbers(values, scale, shift)
                state = held.setdefault(x.shape[1], Moments(x.shape[1]))
                for row in x.astype(float):
                    state.add(row)
                # in parts whose sums 64 bits hold
                step = max(1, _LONG // max(1, int(np.abs(x).max())))
                for at in range(0, len(x), step):
                    state.sums = [s + t for s, t in zip(state.sums, x[at : at + step].sum(0).tolist(), strict=True)]
        if held:
            yield Moments.batch(held)

    source = vectors.select(F.col(vector_col).alias("v"))
    fits = {r.dim: Fit.of(r.n, [int(s) for s in r.sums], _covariance(r), most) for r in _merged(source.mapInArrow(gather, STATE)).collect()}

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, values in rows_of(b.column(1)):
                dim = values.shape[1]
                fit = fits[dim]
                apart = fit.apart(whole_numbers(values, scale, shift))
                w = (apart / fit.n).astype(float) @ fit.axes
                whitened = pa.array([[None if math.isnan(c) else c for c in r] for r in w.tolist()], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array([dim] * len(rows), pa.int32()), pa.array([fit.n] * len(rows), pa.int64()), pa.array(_deviations(apart), pa.int64()), whitened, pa.array([fit.explained] * len(rows), pa.list_(pa.float64()))],
                    names=["vec_id", "dim", "n", "deviation", "w", "explained"],
                )

    kind = vectors.schema[id_col].dataType.simpleString()
    done = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(project, f"vec_id {kind}, dim int, n long, deviation long, w array<double>, explained array<double>")
    done = stored(done, "whitened")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Moments of the whitened vectors; what is null counts as 0 and is left out below."""
        held: dict[int, Moments] = {}
        for b in batches:
            for x in b.column(0).to_pylist():
                held.setdefault(len(x), Moments(len(x))).add(np.array([c or 0.0 for c in x]))
        if held:
            yield Moments.batch(held)

    errors = {}
    for dim, fit in fits.items():
        r = _merged(done.where(F.col("dim") == dim).select("w").mapInArrow(measure, STATE)).first()
        real = np.array([e > 0 for e in fit.explained])
        off = np.abs(_covariance(r) - np.eye(r.dim))[np.ix_(real, real)]
        errors[dim] = float(off.max()) if off.size else 0.0
    of_length = F.create_map(*[F.lit(x) for pair in errors.items() for x in pair])[F.col("dim")] if errors else F.lit(None).cast("double")
    each = done.select("vec_id", "dim", "n", "deviation", "explained", F.posexplode("w").alias("p", "whitened"))
    return each.select("vec_id", (F.col("p") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("p")].alias("explained"), of_length.alias("identity_error"))


def _covariance(r) -> np.ndarray:
    state = Moments(r.dim)
    state.merge(r.n, np.frombuffer(bytes(r.mean), "<f8"), np.frombuffer(bytes(r.spread), "<f8").reshape(r.dim, r.dim), [0] * r.dim)
    return state.covariance()
