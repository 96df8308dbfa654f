"""Whitening of vectors by shifted CholeskyQR.

The centred rows X of the distinct vectors are never moved. A pass sums the Gram matrix of X as
orthogonalised so far; its Cholesky factor R_k, of a slightly shifted matrix the first time,
orthogonalises further: X R_1^-1 R_2^-1 ... by triangular solves. The product of the factors is the R
of X = QR, and its singular value decomposition gives the principal components of X without ever
squaring its condition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txmetrics.functions.columns import col
from txmetrics.sinks.tables import materialise

#: Units of a vector's entry in one.
SCALE = 256
#: Entries of this size and more are treated as not finite: their sums would leave 64 bits.
LARGEST = 2.0**31
#: Bytes of partial sums that one task, or the driver, adds up at a time, but two of them at least.
FOLD_BYTES = 16 << 20
#: Gram passes at most; three suffice unless the shift has to be repeated.
MOST_PASSES = 8
_LOW = 20


@dataclass(frozen=True)
class Whitening:
    """``mean`` and ``sums`` by dimension of the ``n`` distinct vectors; ``axes``: unit components as
    rows, with their ``variances``; ``trace`` of the covariance; ``identity_error``: the largest
    entry of the whitened covariance minus the identity."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.axes / np.sqrt(self.variances)[:, None]).T


def scaled(vector: Column) -> Column:
    """floor(SCALE * c) of every entry as long; null for a vector that is null or has an unusable entry."""
    usable = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < LARGEST), F.lit(False)))
    return F.when(usable, F.transform(vector, lambda c: F.floor(c * float(SCALE)).cast("long")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    values = column.flatten() if column.null_count == 0 else column.drop_null().flatten()
    return values.to_numpy(zero_copy_only=False).reshape(-1, size)


def _summed(rows: DataFrame, size: int, length: int, kind: type, part: Callable[[np.ndarray], np.ndarray], name: str) -> np.ndarray:
    """``part`` of the vectors in every batch, ``length`` numbers, summed over all of them.

    Tasks leave one partial sum each. These are folded, a bounded number at a time, until the last
    few are added up in the driver, in a fixed order.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(length, kind)
        for batch in batches:
            total += part(_matrix(batch.column(0), size))
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "block": pa.array([total.tobytes()], pa.binary())})

    def fold(key, table):
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "block": pa.array([_added(table, kind, length).tobytes()], pa.binary())})

    at_once = max(2, FOLD_BYTES // (8 * length))
    schema = "part long, block binary"
    parts = materialise(rows.mapInArrow(each, schema), name)
    while parts.count() > at_once:
        groups = parts.select(F.expr(f"part div {at_once}").alias("group"), "part", "block")
        parts = materialise(groups.groupBy("group").applyInArrow(fold, schema), name)
    return _added(parts.toArrow(), kind, length)


def _added(table: pa.Table, kind: type, length: int) -> np.ndarray:
    total = np.zeros(length, kind)
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    for k in order.tolist():
        total += np.frombuffer(table.column("block")[k].as_py(), kind)
    return total


def right_solve(x: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Y with Y ``upper`` = ``x`` for an upper triangular matrix, column by column in blocks."""
    size = len(upper)
    if size > 32:
        half = size // 2
        left = right_solve(x[:, :half], upper[:half, :half])
        return np.hstack([left, right_solve(x[:, half:] - left @ upper[:half, half:], upper[half:, half:])])
    out = np.empty_like(x)
    for j in range(size):
        out[:, j] = (x[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


def _cholesky(gram: np.ndarray, shift: float) -> np.ndarray:
    return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T


def _root(gram: np.ndarray) -> np.ndarray:
    """A factor C with C^T C = ``gram`` that may be singular."""
    values, vectors = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(values, 0))[:, None] * vectors.T


def _factor(fit: DataFrame, size: int, n: int, mean: np.ndarray) -> tuple[np.ndarray, float]:
    """R of the centred rows, and their squared norm."""
    factors: list[np.ndarray] = []
    norm = 0.0
    for k in range(MOST_PASSES):
        held = list(factors)

        def gram(x: np.ndarray, held=held) -> np.ndarray:
            y = x - mean
            for factor in held:
                y = right_solve(y, factor)
            return (y.T @ y).reshape(-1)

        found = _summed(fit, size, size * size, np.float64, gram, "whitening-gram").reshape(size, size)
        norm = norm or float(np.trace(found))
        values = np.linalg.eigvalsh(found)
        if values[-1] <= 0:
            return np.zeros((size, size)), 0.0
        rounding = 11 * (n * size + size * (size + 1)) * np.finfo(float).eps / 2
        # directions that the rows do not have stay without length; all others have length one in the end
        near_one, empty = abs(values - 1) < 0.5, values < max(rounding, 1e-12)
        if k + 1 == MOST_PASSES or k and (near_one | empty).all():
            break
        try:
            factors.append(_cholesky(found, rounding * float(values[-1]) if not k else 0.0))
        except np.linalg.LinAlgError:
            factors.append(_cholesky(found, max(rounding, 1e-14) * float(values[-1])))
    whole = _root(found)
    for factor in reversed(factors):
        whole = whole @ factor
    return whole, norm


def fit_whitening(fit: DataFrame, size: int, components: int) -> Whitening | None:
    """The whitening of distinct vectors (``x`` array<long> of ``size`` entries); None if there is none."""
    mask = (1 << _LOW) - 1

    def count(x: np.ndarray) -> np.ndarray:
        # sums of high and low bits, neither of which can leave 64 bits
        return np.concatenate([[len(x)], (x >> _LOW).sum(0), (x & mask).sum(0)])

    counted = _summed(fit, size, 2 * size + 1, np.int64, count, "whitening-sums").tolist()
    n = counted[0]
    if n < 2:
        return None
    sums = [(hi << _LOW) + lo for hi, lo in zip(counted[1 : size + 1], counted[size + 1 :], strict=True)]
    mean = np.array([s / n for s in sums])
    whole, norm = _factor(fit, size, n, mean)
    _, singular, axes = np.linalg.svd(whole)
    kept = min(components, int((singular > singular[0] * max(n, size) ** 0.5 * 1e-14).sum())) if norm else 0
    if not kept:
        return None
    axes = axes[:kept] * np.sign(axes[np.arange(kept), abs(axes[:kept]).argmax(1)])[:, None]
    found = Whitening(n, sums, axes, singular[:kept] ** 2 / n, norm / n, 0.0)

    def check(x: np.ndarray) -> np.ndarray:
        y = found.project(x)
        return np.concatenate([y.sum(0), (y.T @ y).reshape(-1)])

    checked = _summed(fit, size, kept + kept * kept, np.float64, check, "whitening-check") / n
    covariance = checked[kept:].reshape(kept, kept) - np.outer(checked[:kept], checked[:kept])
    return Whitening(n, sums, axes, found.variances, found.trace, float(abs(covariance - np.eye(kept)).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of (n x - S)^2 over the dimensions, exactly; None where it does not fit 64 bits."""
    rough = ((n * x.astype(float) - np.array(sums, float)) ** 2).sum(1)
    plain = (rough < 4e18) & (abs(x).max(1, initial=0).astype(float) * n < 4e18) & (max(map(abs, sums), default=0) < 2**62)
    out: list[int | None] = [None] * len(x)
    if plain.any():
        apart = n * x[plain] - np.array(sums, np.int64)
        for k, value in zip(np.flatnonzero(plain).tolist(), (apart * apart).sum(1).tolist(), strict=True):
            out[k] = value
    for k in np.flatnonzero(~plain & (rough < 1e19)).tolist():
        value = sum((n * v - s) ** 2 for v, s in zip(x[k].tolist(), sums, strict=True))
        out[k] = value if value < 2**63 else None
    return out


def whiten(rows: DataFrame, components: int = 4, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Whitened principal components of every usable vector, one row for each component.

    Entries become integers x = floor(256 c). The fit is over each distinct vector once: ``n`` of
    them, with sums S by dimension. Returns ``vec_id``, ``component`` (from 1, by falling
    variance), ``n``, ``deviation`` long (the sum of (n x - S)^2 over the dimensions), ``whitened``
    double (the centred vector on the unit component, over the root of its variance), ``explained``
    double (the component's share of the whole variance) and ``identity_error`` double.

    Left out: null vectors, vectors with a null, NaN or infinite entry or one of 2^31 and more, empty ones,
    and those whose length is not the usual one among distinct vectors (the longer one if two are equally common).
    Repeated rows and null ids stay, each with its own result; copies weigh nothing in the fit. There
    are fewer components if the vectors have fewer dimensions or span fewer directions, and no rows at all for
    an empty table or fewer than two distinct vectors. Components of equal variance are any
    orthonormal choice, the same for all rows; the sign makes a component's largest entry positive.
    A deviation that does not fit 64 bits is null. Columns other than id and vector are not read.

    The driver and each task hold a few matrices of dimension squared, whatever the number of rows.
    """
    usable = rows.select(col(id_column).alias("vec_id"), scaled(col(vector_column).cast("array<double>")).alias("x")).where("x IS NOT NULL")
    fit = materialise(usable.select("x").distinct(), "whitening-fit")
    sizes = fit.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = usual[0]["size"] if usual else 0
    found = fit_whitening(fit.where(F.size("x") == size), size, components) if size else None
    kind = usable.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    kept = len(found.axes)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), size)
            times = len(x)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(pa.array(np.repeat(np.arange(times), kept))),
                    "component": pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), times)),
                    "n": pa.array(np.full(times * kept, found.n, np.int64)),
                    "deviation": pa.array([v for v in deviations(x, found.n, found.sums) for _ in range(kept)], pa.int64()),
                    "whitened": pa.array(found.project(x).reshape(-1)),
                    "explained": pa.array(np.tile(found.variances / found.trace, times)),
                    "identity_error": pa.array(np.full(times * kept, found.identity_error)),
                }
            )

    return usable.where(F.size("x") == size).mapInArrow(each, schema)
