"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Vectors become whole numbers, so that equal vectors are one row of the fit list and sums are exact. Spark
adds up the centred scatter of the fit list in two passes; the driver sees one matrix of dimension times
dimension. Its pivoted Cholesky factor L (V = L L') is rotated from the right until its columns are
orthogonal: their squared norms are the eigenvalues of V, the normalised columns its eigenvectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import bounded_batches, written

SCALE, OFFSET = 64, 1_000_000
# Scaled entries beyond this are no exact whole numbers as doubles.
EXACT = float(1 << 52)


@dataclass(frozen=True)
class Whitener:
    """n vectors of the fit list, their sums (dimension), components (dimension x k), eigenvalues (k), trace and check."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def vectors(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """All columns but the vector, and ``x``: floor(64 c) + 1000000 of each entry c, as long.

    Rows are left out where the vector is null or empty, or holds a null, a non-finite entry or one beyond 2**52 / 64.
    """
    c = F.transform(F.col(vec), lambda v: v.cast("double") * SCALE)
    # A comparison with NaN takes it as the largest number, so NaN fails the bound as infinity does.
    fine = F.forall(F.col(vec), lambda v: v.isNotNull() & (F.abs(v.cast("double") * SCALE) <= EXACT))
    kept = rows.filter(F.col(vec).isNotNull() & (F.size(vec) > 0) & fine)
    return kept.select(*[k for k in rows.columns if k not in (vec, "x")], F.transform(c, lambda v: F.floor(v).cast("long") + OFFSET).alias("x"))


def _matrix(batch, d: int) -> np.ndarray:
    """The ``x`` column of an Arrow batch as rows of whole numbers."""
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(fit: DataFrame, d: int, values) -> np.ndarray:
    """Sum of ``values(rows of x)``, a matrix of doubles: one partial matrix per task, whose cells Spark adds up."""

    def partial(batches):
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                v = values(_matrix(b, d))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    parts = fit.select("x").mapInArrow(partial, "i int, v array<double>")
    got = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((got["i"].max() + 1, got["j"].max() + 1))
    out[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    return out


def _exact_sums(fit: DataFrame, d: int) -> tuple[int, ...]:
    """Sums per dimension as whole numbers of any size."""

    def partial(batches):
        from decimal import Decimal

        import pyarrow as pa

        total = [0] * d
        for b in batches:
            # A batch has 512 rows of entries below 2**53: no overflow.
            total = [t + int(v) for t, v in zip(total, _matrix(b, d).sum(0))] if b.num_rows else total
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["j", "s"])

    got = fit.select("x").mapInArrow(partial, "j int, s decimal(38,0)").groupBy("j").agg(F.sum("s").alias("s")).collect()
    by = {r.j: int(r.s) for r in got}
    return tuple(by[j] for j in range(d))


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (dimension x rank) with L L' = v, the largest remaining diagonal entry first; stops where nothing but rounding is left."""
    v = np.array(v, dtype=np.float64)
    d = len(v)
    rest = np.diag(v).copy()
    least = d * np.finfo(np.float64).eps * max(rest.max(initial=0.0), 0.0)
    cols: list[np.ndarray] = []
    for _ in range(d):
        p = int(np.argmax(rest))
        if rest[p] <= least:
            break
        col = v[:, p].copy()
        for c in cols:
            col -= c * c[p]
        col /= np.sqrt(rest[p])
        rest = rest - col * col
        rest[p] = -np.inf
        cols.append(col)
    return np.stack(cols, axis=1) if cols else np.zeros((d, 0))


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of factor factor'.

    Columns are rotated in pairs until all are orthogonal to double precision. The pairs of a round
    are disjoint (a round-robin tournament), so a round is one array operation.
    """
    a = np.array(factor, dtype=np.float64)
    k = a.shape[1]
    seats = np.arange(k + k % 2)
    for _ in range(sweeps if k > 1 else 0):
        turned = False
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            p, q = seats[:half], seats[::-1][:half]
            real = (p < k) & (q < k)
            p, q = p[real], q[real]
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            far = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            if far.any():
                turned = True
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    zeta = (beta - alpha) / (2 * gamma)
                    t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                t = np.where(far, t, 0.0)
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    norms = np.sqrt((a * a).sum(0))
    order = np.argsort(-norms, kind="stable")
    norms, a = norms[order], a[:, order]
    real = norms > 0
    units = a[:, real] / norms[real]
    # One sign for all rows: the entry of largest size is positive.
    top = units[np.abs(units).argmax(0), np.arange(units.shape[1])] if units.size else np.ones(0)
    return norms[real] ** 2, units * np.where(top < 0, -1.0, 1.0)


def same_length(x_rows: DataFrame) -> DataFrame:
    """Rows whose vector has the commonest length; of equally common ones the longest."""
    best = x_rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x_rows.filter(F.size("x") == (best.d if best else 0))


def fit_whitener(x_rows: DataFrame, k: int = 16) -> Whitener | None:
    """Fit on the distinct vectors ``x``, all of one length; None where there is no row.

    At most ``k`` components, fewer where the rank is lower: a vector without variance has none. The driver holds
    matrices of dimension x dimension only, whatever the number of rows.
    """
    bounded_batches(x_rows.sparkSession)
    fit = written(x_rows.select("x").distinct(), "whitening-fit")
    n = fit.count()
    if n == 0:
        return None
    d = fit.select(F.size("x").alias("d")).first().d
    sums = _exact_sums(fit, d)
    whole, part = _centre(n, sums)

    def scatter(x):
        y = (x - whole) - part
        return y.T @ y

    v = _summed(fit, d, scatter) / n
    values, units = one_sided_jacobi(pivoted_cholesky(v))
    values, units = values[:k], units[:, :k]
    m, error = len(values), 0.0
    if m:
        weights = units / np.sqrt(values)

        def white(x):
            w = ((x - whole) - part) @ weights
            return np.vstack([w.T @ w, w.sum(0)])

        both = _summed(fit, d, white) / n
        error = float(np.abs(both[:m] - np.outer(both[m], both[m]) - np.eye(m)).max())
    return Whitener(n, sums, units, values, float(np.trace(v)), error)


def _centre(n: int, sums: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The mean as whole numbers, which are taken off exactly, and what is left of it, from 0 to 1."""
    return np.array([s // n for s in sums], dtype=np.int64), np.array([(s % n) / n for s in sums])


def _deviations(x: np.ndarray, n: int, sums: tuple[int, ...], whole: np.ndarray) -> list:
    """Sum over dimensions of (n x - sum) squared, exact; None where it is no long."""
    rest = np.array([s - n * int(w) for s, w in zip(sums, whole)], dtype=np.int64)
    y = x - whole
    most = n * (float(np.abs(y).max(initial=0)) + 1)
    if most * most * len(sums) < 2.0 ** 62:
        z = n * y - rest
        return (z * z).sum(1).tolist()
    exact = [sum((n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in y]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(rows: DataFrame, fitted: Whitener | None, key: str = "vec_id") -> DataFrame:
    """A row per row of ``rows`` (key, x) and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    Equal rows and null keys stay as they are; without a fit, or without variance, there is no row. Extra columns are not read.
    """
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None or not len(fitted.eigenvalues):
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, m, d = fitted.n, fitted.sums, len(fitted.eigenvalues), len(fitted.sums)
    weights = fitted.components / np.sqrt(fitted.eigenvalues)
    explained, error = fitted.eigenvalues / fitted.trace, fitted.identity_error

    def run(batches):
        import pyarrow as pa

        whole, part = _centre(n, sums)
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b, d)
            w = ((x - whole) - part) @ weights
            r = len(x)
            at = np.repeat(np.arange(r), m)
            dev = pa.array(_deviations(x, n, sums, whole), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(key).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), r)), pa.array(np.full(r * m, n, dtype=np.int64)),
                 dev.take(pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, r)), pa.array(np.full(r * m, error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x").mapInArrow(run, schema)
