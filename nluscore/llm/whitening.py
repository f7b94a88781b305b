"""Whitening of embeddings by the leading eigenvectors of their covariance, found by Jacobi-Davidson.

The covariance is never formed: what the method needs are its products with a few vectors at a time, each one
pass over the fit list in which every task centres its vectors, multiplies, and adds up one d x m
matrix; Spark adds those by entry, so the driver sees d x m numbers whatever the number of rows.

Jacobi-Davidson: (1) Rayleigh-Ritz on the search space gives Ritz pairs and their residuals; (2) pairs whose
residual is down to rounding are locked, and the search goes on orthogonal to them; (3) for every
other wanted pair (and a few guards behind them) the correction equation, projected off the locked and the current Ritz
vectors, is solved roughly by inner MINRES, all pairs in lockstep with one distributed product a step; (4) the
corrections enlarge the space, which is cut back to its best Ritz vectors when it gets wide. It ends when
the wanted pairs among all locked and current ones are locked.

Entries are fixed-point integers, x = floor(64 c) + 1000000, so sums are exact; centring takes (n x - S) / n with
an integer numerator.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import need, stored

#: Ritz pairs behind the wanted ones that are corrected too; inner MINRES steps and their aim; outer rounds.
GUARDS, INNER, SHRINK, ROUNDS = 8, 12, 1e-3, 80
#: Bytes of a stored block of the fit list.
BLOCK_BYTES = 4 << 20

Product = Callable[[np.ndarray], np.ndarray]


def minres(apply: Product, rhs: np.ndarray, steps: int, shrink: float) -> np.ndarray:
    """Approximate solutions of symmetric systems, one a column, in lockstep (Lanczos, Givens rotations)."""
    x = np.zeros_like(rhs)
    first = np.linalg.norm(rhs, axis=0)
    open_ = first > 0
    beta, phibar = first.copy(), first.copy()
    v = rhs / np.where(open_, first, 1)
    before, w, w_before = np.zeros_like(v), np.zeros_like(v), np.zeros_like(v)
    cs, sn, dbar, eps = -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for step in range(steps):
        p = apply(v) - (beta * before if step else 0)
        alpha = (v * p).sum(axis=0)
        p -= alpha * v
        beta = np.linalg.norm(p, axis=0)
        old, delta, gbar = eps, cs * dbar + sn * alpha, sn * dbar - cs * alpha
        eps, dbar = sn * beta, -cs * beta
        gamma = np.hypot(gbar, beta)
        open_ &= gamma > 1e-300
        safe = np.where(open_, gamma, 1)
        cs, sn = gbar / safe, beta / safe
        w, w_before = (v - old * w_before - delta * w) / safe, w
        x += np.where(open_, cs * phibar, 0) * w
        phibar = np.where(open_, sn * phibar, 0)
        open_ &= (phibar > shrink * first) & (beta > 1e-14 * first)
        if not open_.any():
            break
        before, v = v, p / np.where(beta > 0, beta, 1)
    return x


def added(basis: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Orthonormal directions of ``new`` that ``basis`` (orthonormal) lacks."""
    out = np.zeros((len(basis), 0))
    for v in new.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            v = v - basis @ (basis.T @ v) - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            out = np.column_stack([out, v])
    return out


def leading_pairs(product: Product, d: int, k: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray, dict]:
    """The ``k`` largest eigenvalues (falling) of a symmetric positive d x d operator, their unit eigenvectors as columns, and
    figures of the search (rounds, products, largest residual against the largest eigenvalue)."""
    calls = 0

    def times(u: np.ndarray) -> np.ndarray:
        nonlocal calls
        calls += 1
        return product(u)

    k = min(k, d)
    wide = min(d, k + GUARDS)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]
    av = times(v)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    for rounds in range(1, ROUNDS + 1):
        h = v.T @ av
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = v @ y, av @ y
        both = np.concatenate([values, theta])
        tolerance = max(d, 64) * np.finfo(float).eps * max(both.max(), 0.0)
        residual = au - u * theta
        residual -= locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        wanted = np.zeros(len(both), bool)
        wanted[np.argsort(-both, kind="stable")[:k]] = True
        fixed = wanted[len(values):] & (size <= tolerance)
        rest = wanted[len(values):] & ~fixed
        locked, values = np.column_stack([locked, u[:, fixed]]), np.append(values, theta[fixed])
        u, au, theta, residual, size, rest = u[:, ~fixed], au[:, ~fixed], theta[~fixed], residual[:, ~fixed], size[~fixed], rest[~fixed]
        if not rest.any():
            break
        # too wide a space is cut back to its best Ritz vectors
        keep = len(theta) if len(theta) + len(values) <= 2 * wide else max(wide - len(values), int(rest.sum()) + GUARDS)
        v, av = u[:, :keep], au[:, :keep]
        aim = np.flatnonzero(rest)
        aim = np.arange(min(len(theta), aim[-1] + 1 + GUARDS, keep))
        aim = aim[size[aim] > tolerance]
        off = np.column_stack([locked, u[:, aim]])
        shift = theta[aim]

        def projected(t: np.ndarray) -> np.ndarray:
            t = t - off @ (off.T @ t)
            t = times(t) - t * shift
            return t - off @ (off.T @ t)

        t = minres(projected, -(residual[:, aim] - off @ (off.T @ residual[:, aim])), INNER, SHRINK)
        new = added(np.column_stack([locked, v]), t)
        if not new.shape[1]:  # nothing to add: the space is whole, or rounding of the kept products holds it up
            v = np.linalg.qr(v - locked @ (locked.T @ v))[0]
            av = times(v)
        else:
            v, av = np.column_stack([v, new]), np.column_stack([av, times(new)])
    else:
        raise RuntimeError(f"{int(rest.sum())} of {k} pairs are not converged after {ROUNDS} rounds, residual {size[rest].max():.3g}")
    # locked pairs were found apart from each other: one Rayleigh-Ritz step over all of them
    q = np.linalg.qr(locked)[0]
    aq = times(q)
    h = q.T @ aq
    theta, y = np.linalg.eigh((h + h.T) / 2)
    theta, y = theta[::-1][:k], y[:, ::-1][:, :k]
    worst = np.linalg.norm(aq @ y - (q @ y) * theta, axis=0).max() / max(theta.max(), np.finfo(float).tiny)
    return theta, q @ y, {"rounds": rounds, "products": calls, "residual": float(worst)}


def usable(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """A column of lists of ``d`` longs as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class FitList:
    """The distinct vectors, stored once in blocks; sums over them are distributed."""

    def __init__(self, rows: DataFrame, d: int):
        """``rows``: column x, arrays of ``d`` longs."""
        self.d = d
        step = max(1, BLOCK_BYTES // (8 * d))

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = matrix(b.column("x"), d)
                parts = [x[k:k + step] for k in range(0, len(x), step)]
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in parts], pa.binary())], names=["x"])

        self.blocks = stored(rows.select("x").distinct().mapInArrow(blocks, "x binary"), "whitening-fit")
        total = self._sum(lambda x: np.append(x.sum(axis=0), len(x)), np.int64)
        self.n = int(total[-1]) if len(total) else 0
        self.sums = total[:-1]

    def _sum(self, of: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
        """Sum of ``of`` (a flat array) over all blocks; empty without blocks."""
        d = self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for block in b.column("x"):
                    part = of(np.frombuffer(block.as_buffer(), np.int64).reshape(-1, d))
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["at", "v"])

        sums = self.blocks.mapInArrow(run, f"at bigint, v {'bigint' if kind is np.int64 else 'double'}").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        out = np.zeros(len(sums), kind)
        out[sums["at"].to_numpy()] = sums["v"].to_numpy()
        return out

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance times the columns of ``u``."""
        n, sums = self.n, self.sums

        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return (c.T @ (c @ u)).reshape(-1)

        return self._sum(part).reshape(u.shape) / n

    def trace(self) -> float:
        n, sums = self.n, self.sums
        return float(self._sum(lambda x: np.array([(centred(x, n, sums) ** 2).sum()]))[0]) / n

    def identity_error(self, to: np.ndarray) -> float:
        """Largest entry of the covariance of x projected by ``to``, minus the identity."""
        n, sums = self.n, self.sums

        def part(x: np.ndarray) -> np.ndarray:
            z = centred(x, n, sums) @ to
            return (z.T @ z).reshape(-1)

        return float(np.abs(self._sum(part).reshape(to.shape[1], -1) / n - np.eye(to.shape[1])).max())


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n with an exact numerator."""
    return (n * x - sums) / n


def squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Exact sum of (n x - S)^2 of every row; None where it is beyond 64 bits."""
    far = n * x - sums
    if float(np.abs(far).max(initial=0)) ** 2 * x.shape[1] < 2.0 ** 62:
        return (far * far).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in far.tolist()]
    return [s if s < 1 << 63 else None for s in exact]


def whiten(vectors: DataFrame, components: int = 16, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), ``components`` rows a vector.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are rows whose
    length is not the most frequent one (ties: the greater). The covariance is that of the distinct integer vectors,
    divisor n; a vector that repeats counts once in it and gets its rows as often as it is there. Components whose eigenvalue
    is zero to rounding (below d x 1e-15 of the trace) can't be whitened and are left out: one distinct vector, or an
    empty table, gives no row. Of equal eigenvalues any orthonormal choice may come. ``deviation`` is null where the exact
    sum has over 63 bits. Null and repeated ids stay as they are, extra columns take no part.
    """
    spark = vectors.sparkSession
    d0 = need(vectors, id_col, vector).toDF("vec_id", "c")
    x = F.transform("c", lambda c: F.floor(c.cast("double") * 64).cast("long") + 1000000)
    clean = d0.where(usable(F.col("c"))).select("vec_id", x.alias("x"))
    sizes = clean.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    kind = d0.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d = int(sizes[0]["d"])
    clean = clean.where(F.size("x") == d)
    fit = FitList(clean, d)
    trace = fit.trace()
    if not trace > 0:
        return spark.createDataFrame([], schema)
    e, vec, _ = leading_pairs(fit.product, d, components)
    some = e > d * 1e-15 * trace
    e, vec = e[some], vec[:, some]
    to = vec / np.sqrt(e)
    n, sums, k, share, off = fit.n, fit.sums, len(e), e / trace, fit.identity_error(to)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column("x"), d)
            rows = np.repeat(np.arange(len(m)), k)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1), len(m)).astype(np.int32)),
                 pa.array(np.full(len(rows), n)), pa.array(squares(m, n, sums), pa.int64()).take(pa.array(rows)),
                 pa.array((centred(m, n, sums) @ to).reshape(-1)), pa.array(np.tile(share, len(m))), pa.array(np.full(len(rows), off))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return clean.mapInArrow(run, schema)
