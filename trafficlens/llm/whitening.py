"""Embedding whitening by incremental eigendecomposition.

A task keeps the spectrum of what it has read: count, mean, eigenvalues and eigenvectors of the centred
scatter. Every vector is a rank-one update: in the basis of the eigenvectors the scatter becomes a
diagonal plus one outer product, whose eigenvalues are the roots of a secular equation. Directions that
the vector does not touch, and all but one of equal eigenvalues, are deflated before. Spectra of tasks are
combined in groups of FAN, again by rank-one updates: one per eigenvector of the other spectrum and one for
the difference of the means. The basis found that way is refined by one distributed Rayleigh-Ritz step: all
vectors, centred by the exact mean, are projected on it, and the eigenvectors of the projected scatter turn it
into components that are right to double precision whatever the updates before have lost.

Only spectra travel, of a size that the dimension bounds; vectors are never shuffled.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.operators.skew import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COMPONENTS = 32
# a spectrum takes in so many others in one task
FAN = 8
STEPS, ORIGIN = 64, 1_000_000
# entries beyond are taken as the limit, so that sums stay whole numbers
LARGEST = 1 << 40
EPS = float(np.finfo(np.float64).eps)
MOST_STEPS = 60
SPECTRUM = "part bigint, n bigint, mean array<double>, vals array<double>, vecs array<double>"


class Spectrum:
    """Eigenvalues (ascending) and eigenvectors (columns) of the centred scatter of n vectors, and their mean."""

    def __init__(self, dim: int):
        self.n, self.mean = 0, np.zeros(dim)
        self.vals, self.vecs = np.zeros(dim), np.eye(dim)

    def add(self, vector: np.ndarray) -> None:
        """One more vector: the scatter grows by n / (n + 1) times the outer square of its distance to the mean."""
        away = vector - self.mean
        self.update(away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        for value, vector in zip(other.vals, other.vecs.T):
            self.update(vector, value)
        total = self.n + other.n
        if total:
            away = other.mean - self.mean
            self.update(away, self.n * (other.n / total))
            self.n, self.mean = total, self.mean + away * (other.n / total)

    def update(self, vector: np.ndarray, weight: float) -> None:
        """Adds weight * vector vector^T (weight at least 0) to the scatter."""
        z = vector @ self.vecs
        square = float(z @ z)
        if weight <= 0 or square == 0:
            return
        norm = square ** 0.5
        z, rho = z / norm, weight * square
        least = 8 * EPS * max(float(self.vals[-1]), rho)
        # untouched directions keep their eigenvalue
        live = np.flatnonzero(np.abs(z) * rho > least)
        if len(live) > 1 and (np.diff(self.vals[live]) <= least).any():
            live = self._rotated(z, live, least)
        if not len(live):
            return
        d = self.vals[live]
        roots, gaps = secular(d, z[live], rho)
        turned = eigenvectors(gaps, d, z[live])
        self.vals[live] = roots
        self.vecs[:, live] = self.vecs[:, live] @ turned
        order = np.argsort(self.vals, kind="stable")
        if (order[1:] < order[:-1]).any():
            self.vals, self.vecs = self.vals[order], self.vecs[:, order]

    def _rotated(self, z: np.ndarray, live: np.ndarray, least: float) -> np.ndarray:
        """Of equal eigenvalues one keeps the whole share of z: the others are turned away from it. Returns what stays live."""
        stays, last = [], int(live[0])
        for k in map(int, live[1:]):
            if self.vals[k] - self.vals[last] <= least:
                both = float(np.hypot(z[last], z[k]))
                c, s = z[k] / both, z[last] / both
                pair = self.vecs[:, [last, k]]
                self.vecs[:, last], self.vecs[:, k] = c * pair[:, 0] - s * pair[:, 1], s * pair[:, 0] + c * pair[:, 1]
                z[last], z[k] = 0.0, both
            else:
                stays.append(last)
            last = k
        return np.array([*stays, last])


def secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z_i^2 / (d_i - x)) for rising d, and the matrix d_i - root_k without cancellation.

    Every root lies between two poles; it is looked for as the distance to the nearer one, by rational
    steps through both poles that a bracket guards.
    """
    m = len(d)
    squares = z * z
    upper = np.append(d[1:], d[-1] + rho * float(squares.sum()))
    width = upper - d
    # sign at the middle tells which pole is nearer; the last root has the upper bound for a pole without weight
    middle = d + width / 2
    at_middle = 1 / rho + (squares[:, None] / (d[:, None] - middle)).sum(0)
    nearer = np.where((at_middle < 0) & (np.arange(m) < m - 1), np.arange(m) + 1, np.arange(m))
    base = d[nearer]
    delta = d[:, None] - base
    low_pole, high_pole = d - base, upper - base
    left = np.where(at_middle < 0, middle - base, low_pole)
    right = np.where(at_middle < 0, high_pole, middle - base)
    eta = (left + right) / 2
    below = np.arange(m)[:, None] <= np.arange(m)
    for _ in range(MOST_STEPS):
        gaps = delta - eta
        terms = squares[:, None] / gaps
        value = 1 / rho + terms.sum(0)
        slopes = terms / gaps
        low_slope = (slopes * below).sum(0)
        high_slope = slopes.sum(0) - low_slope
        done = (np.abs(value) <= 2 * EPS * m * (1 / rho + np.abs(terms).sum(0))) | (right - left <= 2 * EPS * np.abs(eta))
        if done.all():
            break
        left, right = np.where(value < 0, eta, left), np.where(value < 0, right, eta)
        near, far = low_pole - eta, high_pole - eta
        a = (near + far) * value - near * far * (low_slope + high_slope)
        b = near * far * value
        c = value - near * low_slope - far * high_slope
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        moved = eta + step
        inside = (moved > left) & (moved < right)
        eta = np.where(done, eta, np.where(inside, moved, (left + right) / 2))
    return base + eta, delta - eta


def eigenvectors(gaps: np.ndarray, d: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Unit eigenvectors, as columns, of diag(d) + rho z z^T. z is first replaced by the one for which the
    roots found are exact, so that the vectors are orthogonal to working precision."""
    m = len(d)
    apart = d[:, None] - d
    np.fill_diagonal(apart, 1.0)
    # row i: product over k of (d_i - root_k) / (d_i - d_k), its own difference to root_i left over
    exact = np.sqrt(np.abs(np.prod(gaps / apart, axis=1)))
    found = np.copysign(exact, z)[:, None] / gaps
    return found / np.sqrt((found * found).sum(0)) if m > 1 else np.ones((1, 1))


@dataclass(frozen=True)
class Whitening:
    """Fitted on n vectors: exact sums per dimension, eigenvalues of the covariance (falling) and unit eigenvectors as columns."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - sums / n, from whole numbers."""
        whole, rest = zip(*(divmod(s, self.n) for s in self.sums))
        return (x - np.array(whole)).astype(np.float64) - np.array(rest, np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sum over dimensions of (n * x - sums)^2."""
        whole, rest = (np.array(p) for p in zip(*(divmod(s, self.n) for s in self.sums)))
        away = x - whole
        bound = self.n * (int(np.abs(away).max(initial=0)) + 1)
        if len(self.sums) * bound * bound < 1 << 63:
            return ((self.n * away - rest) ** 2).sum(axis=1).tolist()
        exact = away.astype(object) * self.n - rest.astype(object)
        return (exact * exact).sum(axis=1).tolist()


def quantized(vectors: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, x: whole numbers floor(64 * entry) + 1,000,000 of the rows that count, stored.

    Rows whose vector is null, empty or holds a null or non-finite entry are dropped. Vectors must be equally long: those of
    another length than the most frequent one (of several the longest) are dropped as well.
    """
    entry = lambda c: c.cast("double")
    usable = F.col(column).isNotNull() & (F.size(column) > 0)
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    x = F.transform(column, lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), entry(c) * STEPS))) + ORIGIN)
    rows = materialize(vectors.filter(usable & F.coalesce(finite, F.lit(False))).select(F.col(key), x.alias("x")), "vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1).first()
    return rows if lengths is None else rows.filter(F.size("x") == lengths["d"])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _spectra(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        found = Spectrum(dim)
        for batch in batches:
            for vector in (_matrix(batch.column(0), dim) - ORIGIN).astype(np.float64):
                found.add(vector)
        if found.n:
            yield _row(TaskContext.get().partitionId(), found)
    return run


def _row(part: int, found: Spectrum) -> pa.RecordBatch:
    lists = [pa.array([v.ravel()], pa.list_(pa.float64())) for v in (found.mean, found.vals, found.vecs)]
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([found.n], pa.int64()), *lists], ["part", "n", "mean", "vals", "vecs"])


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    spectra = []
    for row in group.sort_values("part").itertuples():
        one = Spectrum(len(row.mean))
        one.n, one.mean, one.vals = int(row.n), np.array(row.mean), np.array(row.vals)
        one.vecs = np.array(row.vecs).reshape(len(row.mean), -1)
        spectra.append(one)
    for other in spectra[1:]:
        spectra[0].merge(other)
    first = spectra[0]
    return pd.DataFrame({"part": [int(group["part"].min()) // FAN], "n": [first.n], "mean": [first.mean], "vals": [first.vals], "vecs": [first.vecs.ravel()]})


def spectrum(rows: DataFrame, dim: int) -> Spectrum:
    """Spectra of all tasks, combined in rounds. What reaches the driver is one of them, dim * dim numbers."""
    parts = materialize(rows.select("x").mapInArrow(_spectra(dim), SPECTRUM), "spectra")
    while parts.count() > 1:
        parts = materialize(parts.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(_merged, SPECTRUM), "spectra")
    row, found = parts.first(), Spectrum(dim)
    found.n, found.mean, found.vals = row["n"], np.array(row["mean"]), np.array(row["vals"])
    # many updates may leave the basis a little off orthogonal
    found.vecs = np.linalg.qr(np.array(row["vecs"]).reshape(dim, dim))[0]
    return found


def _summed(partial: DataFrame, size: int) -> np.ndarray:
    """Sums position by position of arrays that each task gives."""
    cells = partial.select(F.posexplode("v").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(size)
    for cell in cells:
        total[cell["i"]] = cell["v"]
    return total


def _products(centre, basis: np.ndarray, size: int):
    """Per task the sums of the projected vectors and of their products."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + size * size)
        for batch in batches:
            y = centre(batch.column(0)) @ basis
            total[:size] += y.sum(0)
            total[size:] += (y.T @ y).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])
    return run


def fit(rows: DataFrame) -> Whitening | None:
    """Components of the rows of `quantized`; None if there are none."""
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    dim = first["d"]
    sums = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    n, exact = sums[0]["n"], tuple(int(r["s"]) for r in sorted(sums, key=lambda r: r["i"]))
    rough = Whitening(n, exact, np.zeros(dim), np.eye(dim), 0.0)
    basis = spectrum(rows, dim).vecs
    total = _summed(rows.select("x").mapInArrow(_products(lambda c: rough.centred(_matrix(c, dim)), basis, dim), "v array<double>"), dim + dim * dim)
    scatter = total[dim:].reshape(dim, dim)
    values, turned = np.linalg.eigh((scatter + scatter.T) / 2)
    vectors = (basis @ turned)[:, ::-1]
    # the sign that makes the largest entry positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(dim)])
    values = values[::-1] / n
    return Whitening(n, exact, values, vectors, float(values.sum()))


def _whitened(model: Whitening, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), len(model.sums))
            exact = model.deviations(x)
            flat = (model.centred(x) @ basis).ravel()
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * basis.shape[1], flat)
            fits = [v if v < 1 << 63 else None for v in exact]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fits, pa.int64()), pa.array(map(Decimal, exact), pa.decimal128(38, 0)), lists],
                                             [batch.schema.names[0], "deviation", "deviation_exact", "whitened"])
    return run


def _basis(model: Whitening, components: int) -> np.ndarray:
    """Directions of the leading components over their deviations; components without variance are left out."""
    sure = model.values > model.trace * len(model.values) * 4 * EPS
    kept = min(components, int(sure.sum()))
    return model.vectors[:, :kept] / np.sqrt(model.values[:kept])


def whiten(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """key, deviation, deviation_exact, whitened: an array with one number per component."""
    key = rows.schema[0]
    schema = f"`{key.name}` {key.dataType.simpleString()}, deviation bigint, deviation_exact decimal(38,0), whitened array<double>"
    return rows.mapInArrow(_whitened(model, _basis(model, components)), schema)


def identity_error(whitened: DataFrame, size: int, n: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, counted over all rows."""
    total = _summed(whitened.select("whitened").mapInArrow(_products(lambda c: _matrix(c, size), np.eye(size), size), "v array<double>"), size + size * size)
    mean = total[:size] / n
    return float(np.abs(total[size:].reshape(size, size) / n - np.outer(mean, mean) - np.eye(size)).max())


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact.

    Vectors that are null, empty, hold a null or non-finite entry, or are not as long as most are dropped; entries beyond 2^40 / 64 count as
    that. Rows that repeat, and null ids, count and come out like any other. `deviation` is null where the sum exceeds a long;
    `deviation_exact` has it. Components without variance (of one vector, of equal vectors, of fewer vectors than
    dimensions) are left out: a vector without any gives no row. Equal eigenvalues may come in either order. An empty table gives an
    empty table; other columns are ignored.
    """
    rows = quantized(vectors)
    model = fit(rows)
    size = 0 if model is None else _basis(model, components).shape[1]
    if not size:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    found = materialize(whiten(rows, model, components), "whitened")
    error = identity_error(found, size, model.n)
    explained: Column = F.element_at(F.array(*[F.lit(float(v / model.trace)) for v in model.values[:size]]), F.col("_c") + 1)
    return (found.select("vec_id", "deviation", "deviation_exact", F.posexplode("whitened").alias("_c", "_w"))
            .select("vec_id", (F.col("_c") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation",
                    F.col("_w").alias("whitened"), explained.alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact"))
