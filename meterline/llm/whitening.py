"""PCA whitening of embeddings: block Jacobi-Davidson over matrix-free distributed products."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Fixed-point form of an entry c: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Larger fixed-point entries are no exact doubles.
LARGEST = 2**52
#: Partial sums of more tasks than this are added up by tasks before the driver adds the rest.
FAN_IN = 256
EPS = float(np.finfo(np.float64).eps)
Product = Callable[[np.ndarray], np.ndarray]


class Fit(NamedTuple):
    """What is known of the fit list: rows, their number, exact sums, and a whole-number centre near the mean."""

    points: DataFrame
    dim: int
    n: int
    sums: list[int]
    near: np.ndarray

    @property
    def rest(self) -> np.ndarray:
        """The mean less ``near``; both parts are exact to the last bit, the mean itself as one double would not be."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.near, strict=True)])


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def total(points: DataFrame, size: int, partial: Callable[[np.ndarray], np.ndarray], dim: int, kind: str = "float64") -> np.ndarray:
    """The sum over all rows of ``partial``, a function of a block of rows with ``size`` results.

    Every task gives out one vector. Where tasks are many, they are added up by fewer tasks, level by level, so the
    driver never gets more than FAN_IN vectors.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, dtype=kind)
        for batch in batches:
            if batch.num_rows:
                have += partial(rows_of(batch.column(0), dim))
        yield pa.RecordBatch.from_pydict({"part": [have.tobytes()]})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.zeros(size, dtype=kind)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                have += np.frombuffer(part, dtype=kind)
        yield pa.RecordBatch.from_pydict({"part": [have.tobytes()]})

    parts, tasks = points.select("x").mapInArrow(add, "part binary"), points.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        parts = parts.repartition(tasks).mapInArrow(merge, "part binary")
    found = [np.frombuffer(r["part"], dtype=kind) for r in parts.collect()]
    return np.sum(found, axis=0, dtype=kind) if found else np.zeros(size, dtype=kind)


def fixed_points(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id and x of every usable vector, their dimension).

    Dropped: null and empty vectors, those with a null or non-finite entry or one whose x is over 2**52, and those of
    another length than most (of lengths equally frequent, the largest): they are no points of the same space.
    """
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= LARGEST / SCALE)
    usable = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter((F.size("v") > 0) & ~F.exists("v", bad))
    lengths = usable.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = lengths["dim"] if lengths else 0
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return materialize(usable.filter(F.size("v") == dim).select("vec_id", x.alias("x"))), dim


def fit_list(points: DataFrame, dim: int) -> Fit:
    """Exact sums: every task adds whole numbers in two halves of 26 bits, which no count of rows overflows."""
    low = (1 << 26) - 1

    def halves(x: np.ndarray) -> np.ndarray:
        x = x.astype(np.int64)
        return np.concatenate([[len(x)], (x >> 26).sum(axis=0), (x & low).sum(axis=0)])

    got = [int(v) for v in total(points, 2 * dim + 1, halves, dim, "int64")]
    n, sums = got[0], [(a << 26) + b for a, b in zip(got[1 : dim + 1], got[dim + 1 :], strict=True)]
    return Fit(points, dim, n, sums, np.array([round(s / n) if n else 0 for s in sums], dtype=np.int64))


def covariance_product(fit: Fit) -> Product:
    """V -> C V for the covariance C of the fit list, which is never formed: rows are centred, then multiplied."""
    near, rest, dim = fit.near, fit.rest, fit.dim

    def apply(block: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            centred = (x - near) - rest
            return (centred.T @ (centred @ block)).ravel()

        return total(fit.points, block.size, partial, dim).reshape(block.shape) / fit.n

    return apply


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal base of what ``block`` adds to the orthonormal ``against``; directions lost to rounding go."""
    for _ in range(2):
        block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
    if not block.size:
        return block
    q, sizes, _ = np.linalg.svd(block, full_matrices=False)
    q = q[:, sizes > 1e-8]
    q = q - against @ (against.T @ q)
    return np.linalg.qr(q)[0] if q.size else q


def minres(product: Product, right: np.ndarray, steps: int) -> np.ndarray:
    """MINRES on several right sides at once, each with its own recurrence; one product a step serves them all."""
    tiny = np.finfo(np.float64).tiny
    x, w, w_before = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    r_before, r, y = np.zeros_like(right), right.copy(), right.copy()
    beta = np.linalg.norm(right, axis=0)
    left, beta_before = beta.copy(), np.ones_like(beta)
    cos, sin, delta_bar, eps_next = -np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for k in range(steps):
        v = y / np.maximum(beta, tiny)
        y = product(v)
        if k:
            y = y - r_before * (beta / np.maximum(beta_before, tiny))
        alpha = (v * y).sum(axis=0)
        y = y - r * (alpha / np.maximum(beta, tiny))
        r_before, r, beta_before = r, y, beta
        beta = np.linalg.norm(y, axis=0)
        eps, delta, gamma_bar = eps_next, cos * delta_bar + sin * alpha, sin * delta_bar - cos * alpha
        eps_next, delta_bar = sin * beta, -cos * beta
        gamma = np.maximum(np.hypot(gamma_bar, beta), tiny)
        cos, sin = gamma_bar / gamma, beta / gamma
        step, left = cos * left, sin * left
        w, w_before = (v - eps * w_before - delta * w) / gamma, w
        x = x + step * w
    return x


def jacobi_davidson(product: Product, dim: int, wanted: int, inner: int = 4, rounds: int = 60, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` largest eigenpairs of a symmetric operator that is known by its products.

    Rayleigh-Ritz on a growing subspace; a leading pair whose residual is at the rounding error of a product is locked
    and projected out; the others' correction equations, projected against all locked and current vectors, are solved
    roughly by MINRES, all columns in one product. The subspace restarts from its best Ritz vectors. If residuals no
    longer fall before all are locked, what stands at 1e-11 of the largest value is taken; else it is an error.
    """
    rng = np.random.default_rng(seed)
    locked, values, done = np.zeros((dim, 0)), np.zeros(0), np.zeros((dim, 0))
    base = orthonormal(rng.standard_normal((dim, min(dim, wanted + 4))), locked)
    images, stale, best = product(base), 0, math.inf
    for _ in range(rounds):
        theta, turn = np.linalg.eigh((base.T @ images + images.T @ base) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        ritz, ritz_images = base @ turn, images @ turn
        need = min(wanted - len(values), len(theta))
        residuals = ritz_images[:, :need] - ritz[:, :need] * theta[:need]
        sizes = np.linalg.norm(residuals, axis=0)
        top = max([*np.abs(values), abs(theta[0]), np.finfo(np.float64).tiny])
        good = sizes <= 16 * EPS * math.sqrt(dim) * top
        stale, best = (0, sizes.max()) if sizes.max() < best / 2 else (stale + 1, best)
        if stale >= 4 and sizes.max() <= 1e-11 * top:
            good[:] = True
        lead = need if good.all() else int(np.argmin(good))
        locked, done = np.hstack([locked, ritz[:, :lead]]), np.hstack([done, ritz_images[:, :lead]])
        values = np.concatenate([values, theta[:lead]])
        if len(values) >= min(wanted, dim):
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        best = math.inf if lead else best
        room = 2 * wanted + 8
        base, images = ritz[:, lead : lead + room], ritz_images[:, lead : lead + room]
        active = ~good[lead:]
        shift, around = theta[lead:need][active], np.hstack([locked, ritz[:, lead:need]])
        project = lambda z, q=around: z - q @ (q.T @ z)
        fixes = minres(lambda z, p=project, s=shift: p(product(p(z))) - p(z) * s, project(-residuals[:, lead:][:, active]), inner)
        grown = orthonormal(fixes, np.hstack([locked, base]))
        if not grown.size:  # the corrections lie in the subspace already: widen it at random
            grown = orthonormal(rng.standard_normal((dim, max(1, active.sum()))), np.hstack([locked, base]))
        if grown.size:
            base, images = np.hstack([base, grown]), np.hstack([images, product(grown)])
        if base.shape[1] + locked.shape[1] >= dim:  # rounding is all that is left: fresh images of the whole space
            images = product(base)
    raise RuntimeError("Jacobi-Davidson did not converge")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row per usable vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit list is all usable vectors (see fixed_points) in fixed-point form. Components are numbered from 1 by
    falling variance, at most ``components`` and at most those of the list's rank: along the others nothing varies and
    whitening has no value (a list of one vector, or of equal ones, gives no rows, as an empty one does). Each
    component's largest entry is positive. ``deviation`` is exact; one that no long holds is null. Null and repeated
    ids are rows like others; other columns are ignored.

    Vectors are written once in fixed-point form; each of the few dozen products is one pass over them, in which tasks
    give out one small matrix. The driver holds vectors of ``dim`` entries, never rows.
    """
    points, dim = fixed_points(vectors, id_col, vector_col)
    fit = fit_list(points, dim)
    values, base, trace = np.zeros(0), np.zeros((dim, 0)), 1.0
    near, rest, n = fit.near, fit.rest if fit.n else np.zeros(dim), fit.n
    if n > 1:
        trace = float(total(points, 1, lambda x: np.array([(((x - near) - rest) ** 2).sum()]), dim)[0]) / n
    if n > 1 and trace > 0:
        values, base = jacobi_davidson(covariance_product(fit), dim, min(components, dim, n))
        real = values > dim * EPS * 16 * values[0]
        values, base = values[real], base[:, real]
        base = base * np.sign(base[np.abs(base).argmax(axis=0), np.arange(base.shape[1])])
    k, scaled = len(values), base / np.sqrt(values)
    identity_error = 0.0
    if k:
        mean = total(points, k, lambda x: (((x - near) - rest) @ scaled).sum(axis=0), dim) / n

        def products(x: np.ndarray) -> np.ndarray:
            w = ((x - near) - rest) @ scaled - mean
            return (w.T @ w).ravel()

        identity_error = float(np.abs(total(points, k * k, products, dim).reshape(k, k) / n - np.eye(k)).max())
    excess = [s - n * int(c) for s, c in zip(fit.sums, near, strict=True)]
    explained = values / trace

    def deviations(x: np.ndarray) -> pa.Array:
        off = x - near
        if n * (float(np.abs(off).max(initial=0)) + 1) * math.sqrt(dim) * 2 < 2**31:
            return pa.array(((n * off - np.array(excess, dtype=np.int64)) ** 2).sum(axis=1), pa.int64())
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, excess, strict=True)) for row in off]
        return pa.array([v if v < 2**63 else None for v in exact], pa.int64())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column(1), dim) if batch.num_rows and dim else np.zeros((0, dim), dtype=np.int64)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviations(x).take(each),
                    pa.array((((x - near) - rest) @ scaled).ravel()), pa.array(np.tile(explained, len(x))),
                ],
                names=["vec_id", "component", "deviation", "whitened", "explained"],
            )

    id_type = points.schema["vec_id"].dataType.simpleString()
    found = points.select("vec_id", "x").mapInArrow(project, f"vec_id {id_type}, component int, deviation long, whitened double, explained double")
    return found.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(identity_error).alias("identity_error"))
