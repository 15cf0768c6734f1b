"""Whitening of embeddings by their leading principal components, found by a block Jacobi-Davidson iteration over distributed products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, worker, written

SCALE, COMPONENTS = 64, 32
#: Vectors that the iteration works on at once, steps of the inner solver, vectors that the search space holds before it is cut, and rounds.
BLOCK, INNER, ROOM, ROUNDS = 16, 8, 96, 200
#: Largest absolute value that an entry times SCALE may have.
LARGEST = float(1 << 46)
EPS = np.finfo(float).eps


def _matrix(column: pa.Array) -> np.ndarray:
    """A batch of vectors of one length as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def integral(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """id, y: floor(scale * entry) as longs for each row whose vector and entries are there and finite. An entry beyond LARGEST is an error."""
    whole = F.forall(vec_col, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    y = F.transform(vec_col, lambda c: F.when(F.abs(scaled(c)) <= LARGEST, F.floor(scaled(c)).cast("long")).otherwise(F.raise_error(F.lit("a vector's entry is too large")).cast("long")))
    return vectors.where(F.col(vec_col).isNotNull() & whole).select(F.col(id_col).alias("id"), y.alias("y"))


class Fit:
    """The fit list: rows (a written table of id, y), their number, and sums by dimension (exact). All passes over the rows are Spark jobs that add up in tasks and then by entry."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("y")).alias("a"), F.max(F.size("y")).alias("b")).first()
        if shape["a"] != shape["b"]:
            raise ValueError(f"vectors of {shape['a']} to {shape['b']} entries")
        self.n, self.d = shape["n"], shape["a"] or 0
        self.sums = self._sums() if self.n and self.d else []
        self.mean = np.array([s / self.n for s in self.sums], float)

    def _sums(self) -> list[int]:
        @worker("whitening")
        def add(batches):
            total: list[int] | None = None
            for b in batches:
                if b.num_rows:
                    y = _matrix(b.column(0))
                    part = y.sum(axis=0) if int(np.abs(y).max()) * len(y) < 1 << 62 else y.astype(object).sum(axis=0)
                    total = [a + int(x) for a, x in zip(total or [0] * y.shape[1], part, strict=True)]
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([Decimal(x) for x in total], pa.decimal128(38, 0))], ["i", "s"])

        got = self.rows.select("y").mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
        return [int(r["s"]) for r in sorted(got, key=lambda r: r["i"])]

    def summed(self, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum of of(centred rows of a batch) over all batches, an array of shape: added up in each task, then entry by entry."""
        mean, size = self.mean, int(np.prod(shape))

        @worker("whitening")
        def add(batches):
            total = np.zeros(shape)
            for b in batches:
                if b.num_rows:
                    total += of(_matrix(b.column(0)) - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total.reshape(-1))], ["i", "v"])

        got = self.rows.select("y").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros(size)
        out[got["i"].to_numpy()] = got["v"].to_numpy()
        return out.reshape(shape)

    def product(self, p: np.ndarray) -> np.ndarray:
        """The covariance times p (d, b), without the covariance: each centred row by its own products."""
        return self.summed(p.shape, lambda c: c.T @ (c @ p)) / self.n

    def trace(self) -> float:
        return float(self.summed((1,), lambda c: np.array([np.einsum("ij,ij->", c, c)]))[0]) / self.n


def orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what the columns of t add to the orthonormal columns of against; columns that add nothing are left out."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), 1e-300)
    out: list[np.ndarray] = []
    for j in range(t.shape[1]):
        v = t[:, j]
        for _ in range(3):
            for q in against:
                v = v - q @ (q.T @ v)
            for q in out:
                v = v - q * (q @ v)
            norm = np.linalg.norm(v)
            if norm < 1e-10:
                break
            v = v / norm
        else:
            out.append(v)
    return np.stack(out, axis=1) if out else np.zeros((t.shape[0], 0))


def corrections(product: Callable[[np.ndarray], np.ndarray], fixed: np.ndarray, theta: np.ndarray, residuals: np.ndarray, steps: int) -> np.ndarray:
    """Solves (I - QQ') (V - theta_j) (I - QQ') t_j = -r_j for each column j by MINRES, all columns at once: a step is one distributed product.

    fixed is Q, the locked vectors and the current ones. Columns whose Lanczos vectors end (an invariant space) keep what they have.
    """

    def project(x: np.ndarray) -> np.ndarray:
        return x - fixed @ (fixed.T @ x)

    b = project(-residuals)
    beta = np.linalg.norm(b, axis=0)
    x, live = np.zeros_like(b), beta > 0
    v_old, v = np.zeros_like(b), b / np.where(live, beta, 1)
    w_old, w = np.zeros_like(b), np.zeros_like(b)
    c_old, c = np.ones_like(beta), np.ones_like(beta)
    s_old, s = np.zeros_like(beta), np.zeros_like(beta)
    eta, first = beta.copy(), beta.copy()
    beta = np.zeros_like(beta)
    for _ in range(steps):
        if not live.any():
            break
        p = project(product(v) - v * theta)
        alpha = np.einsum("ij,ij->j", v, p)
        p = p - v * alpha - v_old * beta
        following = np.linalg.norm(p, axis=0)
        # the new column of the tridiagonal matrix, turned by the two rotations before, then by its own
        delta, gamma_2 = c * alpha - c_old * s * beta, s * alpha + c_old * c * beta
        gamma_3, rho = s_old * beta, np.hypot(delta, following)
        ok = live & (rho > EPS * np.maximum(np.abs(theta), 1e-300))
        safe = np.where(ok, rho, 1)
        c_old, c, s_old, s = c, delta / safe, s, following / safe
        w_old, w = w, (v - w_old * gamma_3 - w * gamma_2) / safe
        x = np.where(ok, x + w * (c * eta), x)
        eta = -s * eta
        v_old, v = v, p / np.where(following > 0, following, 1)
        beta = following
        live = ok & (following > EPS * np.abs(theta)) & (np.abs(eta) > 1e-3 * first)
        v = np.where(live, v, 0)
    return project(x)


def jacobi_davidson(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, inner: int = INNER, room: int = ROOM, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and unit eigenvectors (columns) of a symmetric operator on d dimensions that is known by its products only.

    Each round takes the Ritz pairs of the search space, locks leading ones whose residual is at rounding level, and adds
    corrections for the following block. A full space is cut back to its leading Ritz vectors. The driver holds some d x room matrices, whatever the number of rows.
    """
    k = min(k, d)
    rng = np.random.default_rng(seed)
    locked, values = np.zeros((d, 0)), []
    space = orthonormal(rng.standard_normal((d, min(block, d))))
    image, scale = product(space), 0.0
    room = max(room, 3 * block)
    for _ in range(rounds):
        h = space.T @ image
        theta, u = np.linalg.eigh((h + h.T) / 2)
        u, theta = u[:, ::-1], theta[::-1]
        space, image = space @ u, image @ u  # from here on the Ritz vectors themselves
        scale = max(scale, float(np.abs(theta).max(initial=0)))
        tol = 16 * np.sqrt(d) * EPS * scale
        residuals = image - space * theta
        residuals -= locked @ (locked.T @ residuals)
        norms = np.linalg.norm(residuals, axis=0)
        done = 0
        while done < len(theta) and len(values) + done < k and norms[done] <= tol:
            done += 1
        if done:
            locked, values = np.hstack([locked, space[:, :done]]), values + list(theta[:done])
            space, image, theta, residuals = space[:, done:], image[:, done:], theta[done:], residuals[:, done:]
        if len(values) >= k:
            break
        if space.shape[1] + block > room:
            keep = min(space.shape[1], 2 * block)
            space, image, theta, residuals = space[:, :keep], image[:, :keep], theta[:keep], residuals[:, :keep]
        m = min(block, space.shape[1])
        added = np.zeros((d, 0))
        if m:
            fixed = np.hstack([locked, space[:, :m]])
            steps = corrections(product, fixed, theta[:m], residuals[:, :m], inner)
            added = orthonormal(steps, locked, space)
        if not added.shape[1]:  # nothing new from the corrections: residuals, else fresh directions
            added = orthonormal(np.hstack([residuals[:, :m], rng.standard_normal((d, block))]), locked, space)[:, :block]
        if added.shape[1]:
            space, image = np.hstack([space, added]), np.hstack([image, product(added)])
        else:  # the space is whole: its images are taken anew, which takes rounding out
            space = orthonormal(space, locked)
            image = product(space)
    else:
        raise RuntimeError(f"only {len(values)} of {k} components settled in {rounds} rounds")
    image = product(locked)  # once more within the locked vectors
    h = locked.T @ image
    theta, u = np.linalg.eigh((h + h.T) / 2)
    return theta[::-1], (locked @ u)[:, ::-1]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained, identity_error for each row whose vector is whole, and each component.

    All rows that are whole are the fit list. Their entries become longs, floor(scale * entry); adding a constant to all, such as 1000000,
    changes nothing here. deviation: sum over dimensions of (n * entry - sum)^2, exact, null where a long can't hold it. Components: unit
    eigenvectors of the covariance (divisor n) by falling eigenvalue, signed so that the largest entry is positive; those whose
    eigenvalue is at rounding level (no more than d * eps of the largest) are left out, as nothing can be divided by their root.

    Rows with a null vector, or null or non-finite entries, are left out. Rows that repeat and null ids give results each. Vectors of
    unlike lengths are a ValueError, an entry beyond 2^46 / scale an error of Spark. An empty table, one row, or rows that are all the same
    give an empty result. Other columns are left out, so their names can't clash.
    """
    rows = written(integral(vectors, id_col, vec_col, scale), "integral")
    kind = vectors.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = Fit(rows)
    trace = fit.trace() if fit.n and fit.d else 0.0
    if not trace > 0:
        return rows.sparkSession.createDataFrame([], schema)
    values, base = jacobi_davidson(fit.product, fit.d, components)
    held = values > fit.d * EPS * values[0]
    values, base = values[held], base[:, held]
    base = base * np.where(base[np.abs(base).argmax(axis=0), np.arange(base.shape[1])] < 0, -1, 1)
    to_white, k = base / np.sqrt(values), len(values)
    middle = fit.summed((k,), lambda c: (c @ to_white).sum(axis=0)) / fit.n
    spread = fit.summed((k, k), lambda c: (c @ to_white - middle).T @ (c @ to_white - middle)) / fit.n
    error, explained = float(np.abs(spread - np.eye(k)).max()), values / trace
    n, sums, mean = fit.n, fit.sums, fit.mean
    top = max(abs(s) for s in sums)

    def deviations(y: np.ndarray) -> Iterator[int | None]:
        if len(sums) * (n * int(np.abs(y).max()) + top) ** 2 < 1 << 63:
            far = n * y - np.array(sums, np.int64)
            yield from np.einsum("ij,ij->i", far, far).tolist()
        else:
            for row in y.tolist():
                exact = sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))
                yield exact if exact < 1 << 63 else None

    @worker("whitening")
    def project(batches):
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                y = _matrix(part.column(1))
                m = len(y)
                each = np.repeat(np.arange(m), k)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(list(deviations(y)), pa.int64()).take(pa.array(each)),
                    pa.array(((y - mean) @ to_white).reshape(-1)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op13_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """The contract adds 1000000 to each entry; deviations and components are the same without."""
    return whitened(table(spark, sf_dir, "embeddings"))
