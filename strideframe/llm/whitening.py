"""Whitening of embeddings: leading components by LOBPCG, then projection.

The covariance is never formed. Each round multiplies it with a block of
directions, as a sum over partitions of centred rows times their projections,
and solves a small problem (Rayleigh-Ritz) on the span of the iterate, its
residuals and the previous directions. Rounds end when the residual of every
wanted component is at the level of rounding; a last pass over the rows
certifies the components and measures how far the whitened covariance is from
the identity.

Entries are whole numbers, so rows are centred exactly up to one rounding:
with column sums S over n rows, x - S/n is (x - S div n) - (S mod n) / n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.runtime import Scratch, matrix, summed

COMPONENTS, GUARD, ROUNDS, SEED = 16, 8, 500, 3
#: Steps per unit and offset of whole entries; entries beyond BOUND (before the offset) count as BOUND.
STEPS, OFFSET, BOUND = 64, 1_000_000, 1 << 50
#: A residual, as a share of the largest eigenvalue, beyond which components are refused.
CERTIFIED = 1e-8
_EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Whitening:
    """Of n fitted rows: exact column sums, components as columns with falling values (0: none left), the trace of the covariance, the largest certified residual (share of the largest value), rounds, and the largest entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    rounds: int
    identity_error: float | None

    def whole(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x minus the whole part of the mean, and the rest of the mean in n-ths."""
        means = np.array([s // self.n for s in self.sums], dtype=np.int64)
        return x - means, np.array([s % self.n for s in self.sums], dtype=np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        y, rest = self.whole(x)
        return y - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections over the root of their value; NaN where that is zero."""
        root = np.sqrt(np.where(self.values > 0, self.values, np.nan))
        return self.centred(x) @ self.components / root

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2, exact; None where a long can't hold it."""
        y, rest = self.whole(x)
        near = ((self.centred(x) * self.n) ** 2).sum(axis=1)
        with np.errstate(over="ignore"):
            exact = ((y * self.n - rest) ** 2).sum(axis=1).tolist()
        for i in np.flatnonzero(near > 9.2e18):
            exact[i] = sum((int(v) * self.n - int(r)) ** 2 for v, r in zip(y[i], rest, strict=True))
            exact[i] = exact[i] if exact[i] < 1 << 63 else None
        return exact


def whole_vectors(vectors: DataFrame, steps: int = STEPS, offset: int = OFFSET) -> DataFrame:
    """vec_id and x of the vectors without null or non-finite entries: floor(steps * entry) + offset."""
    good = F.expr("embedding is not null and forall(embedding, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    x = f"transform(cast(embedding as array<double>), c -> greatest({-BOUND}L, least({BOUND}L, floor({steps}D * c))) + {offset}L)"
    return vectors.where(good).select("vec_id", F.expr(x).alias("x"))


def _beyond(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what block adds to the orthonormal basis."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > 0] / lengths[lengths > 0]
    for _ in range(3):  # each turn takes away what rounding left of the basis
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10][:, : len(basis) - basis.shape[1]]
    return block


def lobpcg(product: Callable[[np.ndarray], np.ndarray], size: int, k: int, guard: int = GUARD, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric operator, their unit vectors as columns, and the rounds taken.

    product multiplies the operator with a block of columns. ``guard`` more
    columns than wanted are iterated, as the last ones of a block come last.
    Every round works on an orthonormal basis of [iterate, residuals, previous
    directions] and gets its products anew, so rounding does not add up. It ends
    when all k residuals are within rounding of the largest value, or when they
    have not come nearer for ten rounds; the caller certifies what comes out.
    """
    wide = min(size, k + guard)
    x = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, wide)))[0]
    basis, best, since = x, np.inf, 0
    for turn in range(1, rounds + 1):
        on = product(basis)
        small = basis.T @ on
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:wide], y[:, ::-1][:, :wide]
        x, residuals = basis @ y, on @ y - (basis @ y) * values
        worst = np.linalg.norm(residuals[:, :k], axis=0).max()
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if worst <= 64 * _EPS * np.sqrt(size) * abs(values[0]) or since >= 10:
            break
        old = y.copy()
        old[:wide] = 0  # what the step took from residuals and directions
        iterate = np.linalg.qr(x)[0]
        with_residuals = np.hstack([iterate, _beyond(iterate, residuals)])
        basis = np.hstack([with_residuals, _beyond(with_residuals, basis @ old)])
    return values[:k], x[:, :k], turn


def fit(rows: DataFrame, size: int, components: int = COMPONENTS, guard: int = GUARD) -> Whitening:
    """The whitening of rows: column x of ``size`` whole entries each, at least one row, each counting once.

    Only sums over partitions come to the driver: a block of size x 3 (components + guard) at most.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(1 + 2 * size, np.int64)
        for batch in batches:
            x = matrix(batch.column("x"), size)
            total += np.concatenate([[len(x)], (x >> 20).sum(axis=0), (x & (1 << 20) - 1).sum(axis=0)])
        return total

    total = [int(v) for v in summed(rows.select("x"), sums)]
    n, columns = total[0], [(a << 20) + b for a, b in zip(total[1 : 1 + size], total[1 + size :], strict=True)]
    k = min(components, size)
    start = Whitening(n, columns, np.eye(size, k), np.zeros(k), 0.0, 0.0, 0, None)

    def over(of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            at = np.zeros(shape)
            for batch in batches:
                if batch.num_rows:
                    at += of(matrix(batch.column("x"), size))
            return at.ravel()

        return summed(rows.select("x"), part).reshape(shape) / n

    product = lambda block: over(lambda x: (c := start.centred(x)).T @ (c @ block), block.shape)
    trace = float(over(lambda x: np.array((start.centred(x) ** 2).sum()), ()).sum())
    if trace == 0:
        return start
    values, vectors, turns = lobpcg(product, size, k, guard)
    values = np.where(values > size * 4 * _EPS * values[0], values, 0.0)
    found = Whitening(n, columns, vectors, values, trace, 0.0, turns, None)

    def certificate(x: np.ndarray) -> np.ndarray:
        """Products with the components, and sums and products of whitened rows."""
        c, z = found.centred(x), np.nan_to_num(found.whitened(x))
        return np.vstack([c.T @ (c @ vectors), z.sum(axis=0), z.T @ z])

    seen = over(certificate, (size + 1 + k, k))
    residual = float(np.linalg.norm(seen[:size] - vectors * values, axis=0).max() / values[0])
    if residual > CERTIFIED:
        raise ArithmeticError(f"components are certified to {residual:.1e} only after {turns} rounds")
    live = values > 0
    error = seen[size + 1 :] - np.outer(seen[size], seen[size]) - np.eye(k)
    return Whitening(n, columns, vectors, values, trace, residual, turns, float(np.abs(error[np.ix_(live, live)]).max()))


def transform(rows: DataFrame, models: dict[int, Whitening]) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of whole vectors (vec_id, x), by the model of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                model = models.get(int(size))
                if model is None or not size:
                    continue
                some = np.flatnonzero(sizes == size)
                x, k = matrix(batch.column("x").take(pa.array(some)), size), len(model.values)
                z, m = model.whitened(x).ravel(), len(some) * k
                each = lambda v: np.tile(v, len(x))
                columns = [
                    batch.column("vec_id").take(pa.array(np.repeat(some, k))),
                    pa.array(each(np.arange(1, k + 1, dtype=np.int32))),
                    pa.array(np.full(m, model.n)),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(z, mask=np.isnan(z)),
                    pa.array(each(model.values / model.trace if model.trace else model.values)),
                    pa.array([model.identity_error] * m, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, scratch: Scratch | None = None) -> DataFrame:
    """The first ``components`` whitened coordinates of every vector, one row each; columns as ``transform`` gives them.

    Vectors that are null or hold null or non-finite entries have no rows, nor
    have empty ones; a null vec_id stays, repeated rows come out as often as
    they come in but count once in the fit. Vectors of different lengths are
    whitened apart. A vector of fewer entries than ``components`` has as many as
    it has entries. Where the fitted rows have no variance left (fewer distinct
    vectors than components), whitened is null and explained 0. Entries of
    2^50 / 64 and more count as that; a deviation too large for a long is null.
    Extra columns are not read; no vectors, no rows.
    """
    scratch = scratch or Scratch(vectors.sparkSession)
    rows = whole_vectors(vectors)
    listed = scratch.put(rows.select("x").distinct(), "fit")
    sizes = [r["size"] for r in listed.select(F.size("x").alias("size")).distinct().collect()]  # a row for each length
    models = {size: fit(listed.where(F.size("x") == size), size, components) for size in sizes if size}
    return transform(rows, models)
