"""Whitening of embeddings by the leading eigenvectors of their covariance (Jacobi-Davidson).

The covariance is never formed. Its product with a few columns is one pass over the vectors: each task centres its rows,
multiplies them by the columns and the result by the rows again, and Spark adds the tasks' sums. The driver keeps columns
of the vectors' dimension only.

Each round takes the best approximations in the subspace (Rayleigh-Ritz). Those whose residual reaches double precision
are locked. For the others the correction equation, projected off everything locked and approximated, is solved by some
steps of MINRES, all columns in one pass per step, and the solutions extend the subspace. A full subspace starts again
from its best approximations.

Defined cases: rows whose vector is null or holds null or non-finite entries take no part, nor do those of another
dimension than the most frequent one (ties: the larger), nor rows with an entry of 2 ** 19 or more, whose exact sums would
not fit. Null and repeated ids are passed through. Without a remaining vector, or for components whose variance is zero
to double precision, there are no rows; fewer dimensions give fewer components. ``deviation`` is null where it exceeds a
long; ``deviation_exact`` holds all digits as text. Only the id and vector columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import slices

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
LARGEST = float(1 << 19)
INNER_STEPS = 3
MAX_ROUNDS = 300
BATCH = 4096
EPS = np.finfo(np.float64).eps

Product = Callable[[np.ndarray], np.ndarray]


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)
    kept = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(good(c), F.lit(False))))
    return kept.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(table: DataFrame, size: int, kind: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum over all rows of ``part`` of the rows of a batch, ``size`` numbers."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64 if kind == "long" else np.float64)
        for b in slices(batches, BATCH):
            total += part(matrix(b["x"]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["place", "value"])

    sums = table.select("x").mapInArrow(added, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    out[sums["place"].to_numpy()] = sums["value"].to_numpy()
    return out


def covariance_product(table: DataFrame, mean: np.ndarray, n: int) -> Product:
    """The covariance of the rows times some columns, in one pass."""

    def product(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ columns)).ravel()

        return summed(table, columns.size, "double", part).reshape(columns.shape) / n

    return product


def off(space: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Columns without their part in ``space``; twice, for full precision."""
    for _ in range(2):
        columns = columns - space @ (space.T @ columns)
    return columns


def extended(space: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """The orthonormal columns that ``columns`` add to ``space``."""
    new = []
    for c in columns.T:
        size = np.linalg.norm(c)
        if size == 0 or not np.isfinite(size):
            continue
        c = off(np.column_stack([space, *new]), (c / size)[:, None])[:, 0]
        if np.linalg.norm(c) > 1e-10:
            c = off(np.column_stack([space, *new]), (c / np.linalg.norm(c))[:, None])[:, 0]
            new.append(c / np.linalg.norm(c))
    return np.column_stack(new) if new else np.empty((len(space), 0))


def minres(product: Product, theta: np.ndarray, fixed: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """Approximate t with (I - QQ')(A - theta)(I - QQ') t = -residual, one column per theta, Q = ``fixed``."""
    k = len(theta)
    rhs = off(fixed, -residual)
    beta = np.linalg.norm(rhs, axis=0)
    live = beta > 0
    v_old, v = np.zeros_like(rhs), np.divide(rhs, beta, where=live, out=np.zeros_like(rhs))
    t, w, w_old = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    eta, b = beta.copy(), np.zeros(k)
    c, c_old, s, s_old = np.ones(k), np.ones(k), np.zeros(k), np.zeros(k)
    for _ in range(steps):
        # Lanczos step
        y = off(fixed, product(v) - theta * v)
        alpha = (v * y).sum(axis=0)
        y = y - alpha * v - b * v_old
        b_new = np.linalg.norm(y, axis=0)
        # the rotations so far, then the one that removes b_new
        first = c * alpha - c_old * s * b
        size = np.hypot(first, b_new)
        second, third = s * alpha + c_old * c * b, s_old * b
        live &= size > EPS * np.abs(theta)
        safe = np.where(live, size, 1.0)
        c_old, c, s_old, s = c, first / safe, s, b_new / safe
        w_new = (v - third * w_old - second * w) / safe
        w_old, w = w, w_new
        t = t + np.where(live, c * eta * w_new, 0.0)
        eta = -s * eta
        live &= b_new > EPS * np.abs(theta)
        v_old, v = v, np.divide(y, b_new, where=live, out=np.zeros_like(y))
        b = b_new
        if not live.any():
            break
    return t


def leading(product: Product, dim: int, k: int, inner: int = INNER_STEPS, room: int | None = None, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their eigenvectors, with residuals of some units of rounding of the largest one."""
    rng = np.random.default_rng(seed)
    room = min(dim, room or max(4 * k, 64))
    tolerance = max(dim, 64) * EPS
    locked, values = np.empty((dim, 0)), np.empty(0)
    space = extended(locked, rng.standard_normal((dim, min(room, 2 * k))))
    image = product(space)
    for _ in range(MAX_ROUNDS):
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        want = min(k - len(values), space.shape[1])
        top, theta_top = space[:, :want], theta[:want]
        residual = image[:, :want] - top * theta_top
        residual = off(locked, residual)
        scale = max(values.max(initial=0.0), theta_top.max(initial=0.0))
        size = np.linalg.norm(residual, axis=0)
        # lock from the front only, so that components come in falling order
        done = int(np.argmin(np.append(size <= tolerance * scale, False)))
        locked, values = np.column_stack([locked, top[:, :done]]), np.append(values, theta_top[:done])
        if len(values) == k or locked.shape[1] == dim:
            break
        space, image = space[:, done:], off(locked, image[:, done:])
        top, theta_top, residual = top[:, done:], theta_top[done:], residual[:, done:]
        if not space.shape[1]:
            space = extended(locked, rng.standard_normal((dim, min(room, dim - locked.shape[1], 2 * k))))
            image = off(locked, product(space))
            continue
        if locked.shape[1] + space.shape[1] >= dim:
            # the subspace is whole, and only rounding is left: take the images anew
            image = off(locked, product(space))
            tolerance *= 2
            continue
        if space.shape[1] + len(theta_top) > room:
            keep = max(len(theta_top) + 2, min(2 * k, room - len(theta_top)))
            space, image = space[:, :keep], image[:, :keep]
        fixed = np.column_stack([locked, top])
        step = minres(product, theta_top, fixed, residual, inner)
        new = extended(np.column_stack([locked, space]), np.column_stack([step, residual]) if not step.any() else step)
        if not new.shape[1]:
            new = extended(np.column_stack([locked, space]), rng.standard_normal((dim, 1)))
        space, image = np.column_stack([space, new]), np.column_stack([image, off(locked, product(new))])
    else:
        raise RuntimeError("eigenvectors have not converged")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


def squared_sums(d: np.ndarray) -> list[int]:
    """Exact sum of squares of each row of whole numbers, by parts of 21 bits."""
    d = np.abs(d)
    low, mid, high = d & 0x1FFFFF, (d >> 21) & 0x1FFFFF, d >> 42
    parts = [((low, low, 1), 0), ((low, mid, 2), 21), ((low, high, 2), 42), ((mid, mid, 1), 42), ((mid, high, 2), 63), ((high, high, 1), 84)]
    sums = [((a * b).sum(axis=1).tolist(), times, shift) for (a, b, times), shift in parts]
    return [sum((times * s[i]) << shift for s, times, shift in sums) for i in range(len(d))]


def nothing(spark: SparkSession, kind: str) -> DataFrame:
    return spark.createDataFrame([], schema(kind))


def schema(kind: str) -> str:
    return f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def whiten(vectors: DataFrame, k: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part and component, with the columns of ``schema``."""
    spark = vectors.sparkSession
    table = materialize(integer_vectors(vectors, id_col, vector_col), "whitening-vectors")
    kind = table.schema["vec_id"].dataType.simpleString()
    dims = table.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if dims is None:
        return nothing(spark, kind)
    dim, n = dims["dim"], dims["n"]
    table = table.where(F.size("x") == dim)
    total = summed(table, dim, "long", lambda x: x.sum(axis=0))
    mean = np.array([int(s) / n for s in total])
    spread = summed(table, dim, "double", lambda x: ((x - mean) ** 2).sum(axis=0)) / n
    trace = float(spread.sum())
    if trace == 0:
        return nothing(spark, kind)
    values, axes = leading(covariance_product(table, mean, n), dim, min(k, dim))
    real = values > dim * EPS * max(values[0], 0.0)
    values, axes = values[real], axes[:, real]
    scale = np.sqrt(values)
    whitened = lambda x: ((x - mean) @ axes) / scale
    centre = summed(table, len(values), "double", lambda x: whitened(x).sum(axis=0)) / n

    def products(x: np.ndarray) -> np.ndarray:
        w = whitened(x) - centre
        return (w.T @ w).ravel()

    covariance = summed(table, len(values) ** 2, "double", products).reshape(len(values), -1) / n
    error = float(np.abs(covariance - np.eye(len(values))).max())
    explained = values / trace

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            x = matrix(b["x"])
            w, many = whitened(x), len(values)
            exact = squared_sums(n * x - total)
            row = pa.array(np.repeat(np.arange(len(b)), many))
            short = pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())
            columns = [
                b["vec_id"].take(row),
                pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(b))),
                pa.array(np.full(len(row), n)),
                short.take(row),
                pa.array(w.ravel()),
                pa.array(np.tile(explained, len(b))),
                pa.array(np.full(len(row), error)),
                pa.array(list(map(str, exact)), pa.string()).take(row),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return table.mapInArrow(written, schema(kind))
