"""Embedding whitening by Chebyshev-filtered subspace iteration.

1. Entries become integers, so that sums and means are exact; vectors that occur several times
   count once in the fit.
2. A block of directions, twice as many as are wanted, is multiplied by the covariance V again and
   again.  Each product is a pass over the vectors: a task centres its rows Z and adds up
   Z'(ZQ), so V itself is never formed and no vector leaves its task.
3. A few Lanczos steps bound the spectrum from below.  Between that bound and the least Ritz value
   of the block lies the unwanted part; the recurrence of a Chebyshev polynomial on that interval
   damps it while what lies above grows.
4. QR and Rayleigh-Ritz turn the filtered block into eigenvector estimates.  The rounds end when
   the residuals of the wanted ones are certified to be at rounding level, and a block of fresh
   random directions, filtered beside them, shows no eigenvalue above the least wanted one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .texts import gather, written

COMPONENTS, SCALE, OFFSET = 16, 64, 1_000_000
#: Degree of the filter, Lanczos steps, directions of the last probe, rounds at most.
DEGREE, LANCZOS, PROBES, ROUNDS = 10, 10, 8, 40
#: A round that leaves more than this share of the residual doubles the block.
SLOW = 0.25
#: Share of the interval from the lower bound to the least Ritz value that counts as unwanted.
UNWANTED = 0.9
#: Residuals, against the largest eigenvalue, that are certified, and that are as good as zero.
CERTIFIED, EXACT = 1e-12, 1e-14
#: Tasks that add up the other tasks' sums; so many small matrices reach the driver.
REDUCERS = 4
SEED = 5
#: Larger entries count as this, so that all arithmetic stays in 64 bits.
LARGEST = 1 << 61


def integer_rows(vectors: DataFrame, column: str, scale: int, offset: int) -> DataFrame:
    """``row`` (the input row) and ``x``, each entry floor(scale * c) + offset; rows without a
    vector, or with a null or non-finite entry, are left out."""
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    most = float(LARGEST)
    whole = lambda c: F.floor(
        F.greatest(F.lit(-most), F.least(F.lit(most), c * scale))
    ).cast("long") + F.lit(offset).cast("long")
    return (
        vectors.select(
            F.struct(*[vectors[f"`{c}`"] for c in vectors.columns]).alias("row"),
            vectors[f"`{column}`"].cast("array<double>").alias("c"),
        )
        .where(F.col("c").isNotNull() & ~F.exists("c", bad))
        .select("row", F.transform("c", whole).alias("x"))
    )


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Center:
    """The exact mean of the fit: ``sums / n`` for every dimension, in integers."""

    n: int
    sums: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], np.int64)
        self.rest = np.array([s % self.n for s in self.sums], np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviation(self, x: np.ndarray) -> list:
        """Sums over dimensions of (n * x - sum)^2, exact; None where a long cannot hold it."""
        y = x - self.whole
        reach = (float(np.abs(y).max(initial=0)) + 1) * self.n
        if reach**2 * max(1, x.shape[1]) < 2.0**62:
            return ((y * self.n - self.rest) ** 2).sum(axis=1)
        wide = ((y.astype(object) * self.n - self.rest.astype(object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in wide.tolist()]


def _center(fit: DataFrame) -> Center:
    def add(batches):
        # Halves of each number add up without overflow.
        for batch in batches:
            x = _matrix(batch.column(0))
            yield [
                np.arange(x.shape[1]), (x >> 32).sum(axis=0),
                (x & 0xFFFFFFFF).sum(axis=0), np.full(x.shape[1], len(x)),
            ]

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    rows = (
        gather(fit, "k int, high bigint, low bigint, n bigint", lambda: add)
        .groupBy("k")
        .agg(total("high").alias("high"), total("low").alias("low"), F.sum("n").alias("n"))
        .orderBy("k")
        .collect()
    )
    return Center(rows[0]["n"], [(int(r["high"]) << 32) + int(r["low"]) for r in rows])


def _sum(fit: DataFrame, center: Center, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of ``of(centred rows)`` over all rows; ``of`` gives a small matrix."""

    def add(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + of(center(_matrix(batch.column(0))))
        if np.ndim(total):
            yield [[total.ravel()]]

    def merge(batches):
        total = 0
        for batch in batches:
            for values in batch.column(0):
                total = total + values.values.to_numpy()
        if np.ndim(total):
            yield [[total]]

    field = "v array<double>"
    parts = gather(fit, field, lambda: add).repartition(REDUCERS)
    rows = gather(parts, field, lambda: merge).collect()
    return sum(np.array(r["v"]) for r in rows)


@dataclass
class Whitening:
    """Mean, eigenvalues (falling) and unit eigenvectors (columns) of the covariance."""

    center: Center
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    #: Largest residual of a component against the largest eigenvalue; passes over the data.
    residual: float
    passes: int

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.center(x) @ self.vectors / np.sqrt(self.values)


class Iteration:
    """Subspace iteration on a matrix that is only known by its products with blocks."""

    def __init__(self, product: Callable[[np.ndarray], np.ndarray], width: int, wanted: int):
        self._product = product
        self.width = width
        self.wanted = min(wanted, width)
        self.block = min(2 * wanted, width)
        self.rng = np.random.default_rng(SEED)
        self.passes = 0

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q, in one pass over the vectors."""
        self.passes += 1
        return self._product(q)

    def lower_bound(self) -> float:
        """No eigenvalue is below, from a few Lanczos steps; an eigenvalue is never negative."""
        v = self.rng.normal(size=self.width)
        basis, diagonal, off = [v / np.linalg.norm(v)], [], []
        for _ in range(min(LANCZOS, self.width)):
            w = self.product(basis[-1][:, None])[:, 0]
            diagonal.append(float(basis[-1] @ w))
            for _ in range(2):
                w -= np.array(basis).T @ (np.array(basis) @ w)
            off.append(float(np.linalg.norm(w)))
            if off[-1] <= EXACT * abs(diagonal[0]):
                break
            basis.append(w / off[-1])
        ritz = np.linalg.eigvalsh(
            np.diag(diagonal) + np.diag(off[:-1], 1)[: len(diagonal), : len(diagonal)]
            + np.diag(off[:-1], -1)[: len(diagonal), : len(diagonal)]
        )
        return max(0.0, float(ritz[0]) - off[-1])

    def filtered(self, q: np.ndarray, low: float, high: float, top: float) -> np.ndarray:
        """The scaled Chebyshev polynomial of V on [low, high], 1 at ``top``, times q."""
        middle, half = (high + low) / 2, (high - low) / 2
        first = sigma = half / (top - middle)
        before, now = q, (self.product(q) - middle * q) * (sigma / half)
        for _ in range(DEGREE - 1):
            following = 1 / (2 / first - sigma)
            after = (self.product(now) - middle * now) * (2 * following / half)
            before, now, sigma = now, after - sigma * following * before, following
        return now

    def ritz(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ritz values (falling), vectors and residual norms in the span of q."""
        q = np.linalg.qr(q)[0]
        product = self.product(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        return values, vectors, np.linalg.norm(product @ turn - vectors * values, axis=0)

    def run(self) -> tuple[np.ndarray, np.ndarray, float]:
        start = self.rng.normal(size=(self.width, self.block))
        values, vectors, errors = self.ritz(start)
        if values[0] <= 0:
            return values[:0], vectors[:, :0], 0.0
        low = self.lower_bound() if self.block < self.width else 0.0
        before = np.inf
        for _ in range(ROUNDS):
            worst = errors[: self.wanted].max() / values[0]
            settled = worst <= EXACT or (worst <= CERTIFIED and worst > before * SLOW)
            added = None
            if self.block == self.width or settled:
                added = self.missed(vectors, values, low)
                if added is None:
                    return values[: self.wanted], vectors[:, : self.wanted], float(worst)
                worst = np.inf
            elif worst > before * SLOW:
                # More eigenvalues lie close together than the block holds.
                grown = min(self.width, 2 * self.block) - self.block
                added = self.rng.normal(size=(self.width, grown))
            high = low + UNWANTED * (values[-1] - low)
            if added is not None:
                vectors = np.hstack([vectors, added])[:, : self.width]
                vectors = np.linalg.qr(vectors)[0]
                self.block = vectors.shape[1]
            before = worst
            values, vectors, errors = self.ritz(
                vectors if self.block == self.width
                else self.filtered(vectors, low, high, values[0])
            )
        raise ArithmeticError(f"not certified after {ROUNDS} rounds: residual {worst:.1e}")

    def missed(self, vectors, values, low):
        """Directions with an eigenvalue above the least wanted one that the block does not hold."""
        if self.block == self.width:
            return None
        own = vectors[:, : self.wanted]
        probe = self.rng.normal(size=(self.width, min(PROBES, self.width - self.wanted)))
        probe -= own @ (own.T @ probe)
        high = low + UNWANTED * (values[-1] - low)
        probe = self.filtered(np.linalg.qr(probe)[0], low, high, values[0])
        for _ in range(2):
            probe -= own @ (own.T @ probe)
        found, directions, _ = self.ritz(probe)
        if found[0] <= values[self.wanted - 1] + CERTIFIED * values[0]:
            return None
        return directions


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Whitening of the rows of ``fit(x array<bigint>)``, all of one length; None without rows or
    dimensions.  Directions without variance are no components."""
    if fit.where(F.size("x") > 0).isEmpty():
        return None
    center = _center(fit)
    trace = float(_sum(fit, center, lambda z: (z**2).sum(axis=0)).sum()) / center.n
    width = len(center.sums)

    def product(q):
        total = _sum(fit, center, lambda z: z.T @ (z @ q))
        return total.reshape(q.shape) / center.n

    iteration = Iteration(product, width, components)
    values, vectors, residual = iteration.run()
    used = values > 1e-12 * width * (values[0] if len(values) else 0)
    return Whitening(
        center, values[used], vectors[:, used], trace, residual, iteration.passes
    )


def _identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry, apart from sign, of the covariance of whitened rows minus the identity."""
    k = len(model.values)
    scale = model.vectors / np.sqrt(model.values)

    def moments(z):
        white = z @ scale
        return np.vstack([white.T @ white, white.sum(axis=0)])

    total = _sum(fit, model.center, moments).reshape(k + 1, k) / model.center.n
    covariance = total[:k] - np.outer(total[k], total[k])
    return float(np.abs(covariance - np.eye(k)).max(initial=0))


def whiten(
    vectors: DataFrame,
    column: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
) -> DataFrame:
    """``row`` (the input row), ``n``, ``deviation``, ``whitened`` and ``explained`` (one entry a
    component, by falling eigenvalue) and ``identity_error``.

    Entries become integers floor(scale * c) + offset, those beyond 2^61 count as that.  Rows
    whose vector is null or holds a null or non-finite entry are left out; rows without an id and
    repeated rows stay.  Shorter vectors are continued with zero entries.  The mean and covariance
    are those of the different vectors, divisor ``n``, their number.  ``deviation`` is exact, null
    where a long cannot hold it.  There are as many components as directions with variance,
    ``components`` at most: none, and empty arrays, when all vectors are equal or empty.  Of equal
    eigenvalues any orthogonal directions may come.  Empty tables give no rows.
    """
    rows = integer_rows(vectors, column, scale, offset)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    added = F.array_repeat(F.lit(offset).cast("long"), F.greatest(F.lit(0), width - F.size("x")))
    rows = rows.withColumn("x", F.concat("x", added))
    fit = written(rows.select("x").distinct(), "fit")
    model = fit_whitening(fit, components)
    error = _identity_error(fit, model) if model is not None and len(model.values) else 0.0
    n = model.center.n if model is not None else 1
    explained = (model.values / model.trace).tolist() if model is not None else []

    fields = _parse_datatype_string("deviation bigint, whitened array<double>").fields
    schema = StructType([StructField("row", rows.schema["row"].dataType), *fields])

    def apply(batches):
        for batch in batches:
            if model is None:
                deviation = np.zeros(batch.num_rows, np.int64)
                white = np.zeros((batch.num_rows, 0))
            else:
                x = _matrix(batch.column(1))
                deviation, white = model.center.deviation(x), model(x)
            ends = np.arange(len(white) + 1, dtype=np.int32) * white.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(deviation, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(white.ravel()))],
                names=schema.names,
            )

    shares = F.array(*map(F.lit, explained)) if explained else F.array().cast("array<double>")
    return rows.mapInArrow(apply, schema).select(
        "row",
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        shares.alias("explained"),
        F.lit(error).alias("identity_error"),
    )
