"""Whitening of embeddings by a one-sided Jacobi SVD of the blockwise QR factor (TSQR).

1. Vectors become integers, x = floor(scale * c) + shift. The fit covers each distinct x once; n and the sums S are exact.
2. Each task runs over its share of the fit, centred by S / n, and keeps the triangular factor R of what it has seen: the
   QR of its R on top of the next block. Groups of FAN factors are stacked and reduced to one until one is left. A factor
   has the size of the dimension squared, whatever the number of rows.
3. Plane rotations orthogonalise the columns of the last R, in rounds of disjoint pairs; the accumulated rotations are the
   components, the columns' norms over sqrt(n) their standard deviations, small ones as accurate as large ones. The
   covariance matrix is never formed.
4. Every row is projected. How far the covariance of the projections is from the identity is measured over the fit, in
   one pass for their means and one for their centred products.

Vectors of different lengths are whitened apart, each length as a table of its own; `identity_error` is the largest of all.

Defined cases: a vector that is null, or holds a null, a non-finite entry or one beyond LARGEST / scale, is left out; an
empty vector has no component; directions without spread (a standard deviation below 1e-12 of the largest) have no
component, so a fit of one distinct vector gives no rows; repeated rows and null ids are returned each; a deviation
beyond a long is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import Scratch

#: Factors that one task stacks, and entries of a vector block that is factored or projected at once.
FAN, ENTRIES = 16, 1 << 18
LARGEST = 2.0**50
MASK = (1 << 64) - 1


def integers(vectors: DataFrame, scale: float, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x) of the vectors that can be whitened."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) > LARGEST / scale))
    kept = vectors.filter(v.isNotNull() & ~bad & (F.size(v) > 0))
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long")).alias("x"))


def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row numbers, matrix) of the blocks of a column of integer lists."""
    lengths = column.value_lengths().to_numpy()
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        x = (column if len(at) == len(column) else column.take(pa.array(at))).flatten().to_numpy().reshape(-1, d)
        step = max(1, ENTRIES // int(d))
        for i in range(0, len(at), step):
            yield int(d), at[i : i + step], x[i : i + step]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and place the sum of the entries. Entries are below 2**51, so a block of 2**12 rows fits a long."""
    for batch in batches:
        for d, _, x in by_length(batch.column(0)):
            for i in range(0, len(x), 1 << 12):
                part = x[i : i + (1 << 12)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(part.sum(axis=0)), pa.array(np.full(d, len(part)))], names=["d", "at", "s", "n"])


class Fit:
    """Exact count and sums of the fit of one length, and its components once they are known."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])
        self.axes = self.sd = self.explained = None

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, whose integer part is exact."""
        return (x - self.whole).astype(float) - self.part

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / self.sd

    def deviation(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of (n * x - S) squared, and which rows' fit a long: arithmetic modulo 2**64 is exact for those."""
        wrap = np.array([s & MASK for s in self.sums], np.uint64)
        y = x.astype(np.uint64) * np.uint64(self.n & MASK) - wrap
        rough = ((self.centred(x) * float(self.n)) ** 2).sum(axis=1)
        return (y * y).sum(axis=1, dtype=np.uint64).view(np.int64), rough < 2.0**63 * (1 - 1e-9)


def _factor(blocks: list[np.ndarray]) -> np.ndarray:
    stacked = np.concatenate(blocks)
    return np.linalg.qr(stacked, mode="r") if len(stacked) > stacked.shape[1] else stacked


FACTOR = "d int, node long, r binary"


def _factors(fits: dict[int, Fit]):
    """One triangular factor for each task and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        node = 0
        for batch in batches:
            node = batch.column(0)[0].as_py() if batch.num_rows else node
            for d, _, x in by_length(batch.column(1)):
                held[d] = _factor([held[d], fits[d].centred(x)] if d in held else [fits[d].centred(x)])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([node] * len(held), pa.int64()), pa.array([r.tobytes() for r in held.values()], pa.binary())], names=["d", "node", "r"])

    return run


def _stack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    d, node = (k.as_py() for k in key)
    r = _factor([np.frombuffer(x.as_buffer()).reshape(-1, d) for x in table.column("r")])
    return pa.table({"d": pa.array([d], pa.int32()), "node": pa.array([node], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})


def reduce_factors(factors: DataFrame, scratch: Scratch) -> DataFrame:
    """One factor for each length, by stacking FAN at a time."""
    factors, level = scratch.table("factors-0", factors), 0
    while (factors.agg(F.max("node")).first()[0] or 0) > 0:
        level += 1
        up = factors.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("d", "node").applyInArrow(_stack, FACTOR)
        factors = scratch.table(f"factors-{level}", up)
    return factors


def jacobi(r: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(rotations V, column norms of R V, falling) with orthogonal columns of R V, by sweeps of disjoint plane rotations."""
    d = r.shape[1]
    a, v = np.zeros((d, max(d, len(r)))), np.eye(d)  # columns of R and V are rows here
    a[:, : len(r)] = r.T
    order = np.arange(d + d % 2)
    tiny = np.finfo(float).eps * max(1.0, d**0.5)
    for _ in range(most_sweeps):
        turned = False
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            x, y = a[p], a[q]
            alpha, beta, gamma = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            act = np.abs(gamma) > tiny * np.sqrt(alpha * beta)
            if act.any():
                turned = True
                p, q, x, y, alpha, beta, gamma = (z[act] for z in (p, q, x, y, alpha, beta, gamma))
                with np.errstate(over="ignore"):  # an infinite ratio is a rotation by nothing
                    zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = (1 / np.hypot(1.0, t))[:, None]
                s = c * t[:, None]
                a[p], a[q] = c * x - s * y, s * x + c * y
                x, y = v[p], v[q]
                v[p], v[q] = c * x - s * y, s * x + c * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])
        if not turned:
            break
    norms = np.sqrt((a * a).sum(1))
    fall = np.argsort(-norms, kind="stable")
    return v[fall].T, norms[fall]


def _components(most: int, counts: dict[int, int]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        d = key[0].as_py()
        axes, norms = jacobi(_factor([np.frombuffer(x.as_buffer()).reshape(-1, d) for x in table.column("r")]))
        k = min(most, int((norms > 1e-12 * norms[0]).sum()) if norms[0] > 0 else 0)
        total = float((norms**2).sum())
        axes = axes[:, :k]
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
        return pa.table({"d": pa.array([d], pa.int32()), "axes": pa.array([axes.tobytes()], pa.binary()), "sd": pa.array([(norms[:k] / counts[d] ** 0.5).tolist()], pa.list_(pa.float64())), "explained": pa.array([(norms[:k] ** 2 / total if total else norms[:0]).tolist()], pa.list_(pa.float64()))})

    return run


def _moments(fits: dict[int, Fit], means: dict[int, np.ndarray] | None):
    """A task's sums of the projections, or of the products of their differences from the given means."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column(0)):
                w = fits[d].project(x)
                if means:
                    w = w - means[d]
                held[d] = held.get(d, 0) + (w.T @ w if means else w.sum(0))
        for d, m in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d)), pa.array(np.arange(m.size)), pa.array(m.ravel())], names=["d", "at", "s"])

    return run


def _by_length(sums: DataFrame) -> dict[int, np.ndarray]:
    out: dict[int, list[tuple[int, float]]] = {}
    for r in sums.groupBy("d", "at").agg(F.sum("s").alias("s")).toLocalIterator():  # as many rows as components, squared at most
        out.setdefault(r.d, []).append((r.at, r.s))
    return {d: np.array([s for _, s in sorted(v)]) for d, v in out.items()}


def _rows(fits: dict[int, Fit], error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch.column(1)):
                fit = fits[d]
                k = len(fit.sd)
                if not k:
                    continue
                deviation, fits_long = fit.deviation(x)
                columns = [
                    batch.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(at) * k, fit.n)), pa.array(np.repeat(deviation, k), mask=np.repeat(~fits_long, k)),
                    pa.array(fit.project(x).ravel()), pa.array(np.tile(fit.explained, len(at))), pa.array(np.full(len(at) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(vectors: DataFrame, components: int = 16, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error), one for each vector and component."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = integers(vectors, scale, shift, id_col, vector_col)
    fit = scratch.table("fit", rows.select("x").distinct())
    sums = fit.select("x").mapInArrow(_sums, "d long, at long, s long, n long").groupBy("d", "at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    totals: dict[int, dict[int, tuple[int, int]]] = {}
    for r in sums.toLocalIterator():  # one row for each place of a vector
        totals.setdefault(r.d, {})[r.at] = int(r.s), r.n
    fits = {d: Fit(at[0][1], [at[i][0] for i in range(d)]) for d, at in totals.items()}

    blocks = fit.select(F.spark_partition_id().cast("long").alias("node"), "x")
    factors = reduce_factors(blocks.mapInArrow(_factors(fits), FACTOR), scratch)
    found = factors.groupBy("d").applyInArrow(_components(components, {d: f.n for d, f in fits.items()}), "d int, axes binary, sd array<double>, explained array<double>")
    for r in found.toLocalIterator():
        fits[r.d].axes, fits[r.d].sd, fits[r.d].explained = np.frombuffer(bytes(r.axes)).reshape(r.d, -1), np.array(r.sd), np.array(r.explained)

    means = {d: m / fits[d].n for d, m in _by_length(fit.select("x").mapInArrow(_moments(fits, None), "d long, at long, s double")).items()}
    products = _by_length(fit.select("x").mapInArrow(_moments(fits, means), "d long, at long, s double"))
    errors = [np.abs(p.reshape(len(fits[d].sd), -1) / fits[d].n - np.eye(len(fits[d].sd))).max() for d, p in products.items() if len(p)]
    return rows.mapInArrow(_rows(fits, float(max(errors, default=0.0))), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
