"""Whitening of embeddings by the leading components of their covariance, found with Jacobi-Davidson.

The covariance matrix is never formed. Spark computes centred products
``V @ block = (1/n) * sum of (x - mean) ((x - mean) . block)`` over the fit list,
one job for all columns of a block; the driver keeps a few vectors of the
embedding's length. Around these products:

* Rayleigh-Ritz on the search space gives approximate pairs and residuals.
* Each open pair gets a correction from the projected equation
  ``(I - QQ')(V - theta)(I - QQ') t = -r``, solved roughly by MINRES; the columns
  of a block take their MINRES steps together, so a step is one Spark job.
* Pairs whose residual has reached double precision are locked, in order of
  falling eigenvalue, and projected out of everything that follows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from scenelake.llm.common import arrow_pass, materialise

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
TOLERANCE = 1e-13  # of a residual, relative to the largest eigenvalue
INNER_STEPS = 8  # MINRES steps of one correction
MAX_ROUNDS = 200
PART_BYTES = 16 << 20  # vectors that one task multiplies
FAN_IN = 64  # sums that meet in one task
RANK = 1e-12  # eigenvalues below this share of the largest one have no whitened value


@dataclass(frozen=True)
class Whitening:
    """Mean and components of a fit list; ``vectors`` has one column per component."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


def whole(column: str) -> Column:
    """True for vectors that are not null and hold finite numbers only."""
    entry = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(F.col(column).isNotNull() & F.forall(column, entry), F.lit(False))


def quantised(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Whole vectors as integers: ``id`` and ``x`` = floor(64 c) + 1,000,000, all of one length.

    The length is the one that most rows have (the greater of equals); rows of
    another length, and vectors without entries, are left out.
    """
    sound = rows.select(F.col(key).alias("id"), F.col(column).alias("v")).where(whole("v") & (F.size("v") > 0))
    common = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    x = F.transform("v", lambda c: F.floor(c.cast("double") * SCALE).cast("long") + OFFSET)
    return sound.where(F.size("v") == (common[0]["d"] if common else 0)).select("id", x.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(fit: DataFrame, per_batch) -> np.ndarray | None:
    """Sum of what ``per_batch`` makes of the rows of all batches; None without rows.

    Every task adds up its rows; the sums of ``FAN_IN`` tasks meet in one of the
    next level, until one is left.
    """

    def of_rows(batches):
        yield from added(per_batch(_matrix(b.column(0))) for b in batches if b.num_rows)

    def of_sums(batches):
        yield from added(pickle.loads(v.as_py()) for b in batches for v in b.column(0))

    def added(parts):
        total = None
        for part in parts:
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["data"])

    level, tasks = arrow_pass(fit, of_rows, "data binary"), fit.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        level = arrow_pass(level.repartition(tasks), of_sums, "data binary")
    found = level.collect()
    return pickle.loads(found[0][0]) if found else None


def _counted(x: np.ndarray) -> np.ndarray:
    return np.stack([x.sum(axis=0), np.full(x.shape[1], len(x), dtype=np.int64)], axis=1)


class Centre:
    """Exact centring: a whole part that integers lose first, and the rest of the mean."""

    def __init__(self, n: int, sums: np.ndarray):
        self.n, self.base = n, np.rint(sums / n).astype(np.int64)
        self.rest = sums - n * self.base

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sum over dimensions of (n x - S) squared, as 64-bit integers or not at all."""
        off = x - self.base
        if len(off) and x.shape[1] * (float(self.n) * (float(np.abs(off).max()) + 1)) ** 2 >= 2.0 ** 63:
            exact = [sum((self.n * int(v) - int(r)) ** 2 for v, r in zip(row, self.rest)) for row in off]
            if max(exact) >= 2 ** 63:
                raise OverflowError("a squared deviation exceeds 64 bits")
            return np.array(exact, dtype=np.int64)
        return ((self.n * off - self.rest) ** 2).sum(axis=1)


def _minres(apply, rhs: np.ndarray, steps: int, relative: float) -> np.ndarray:
    """MINRES for several right-hand sides at once, each with its own operator inside ``apply``."""
    x, v_old = np.zeros_like(rhs), np.zeros_like(rhs)
    beta = np.linalg.norm(rhs, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v = rhs / start
    w, w_old = np.zeros_like(rhs), np.zeros_like(rhs)
    cos, cos_old = np.ones(len(beta)), np.ones(len(beta))
    sin, sin_old = np.zeros(len(beta)), np.zeros(len(beta))
    eta, length = beta.copy(), np.zeros(len(beta))
    for _ in range(steps):
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        fresh = av - alpha * v - length * v_old
        next_length = np.linalg.norm(fresh, axis=0)
        # Two old rotations, then a new one that removes the entry below the diagonal.
        r3 = sin_old * length
        r2 = cos_old * cos * length + sin * alpha
        r1 = cos * alpha - cos_old * sin * length
        diagonal = np.hypot(r1, next_length)
        sound = diagonal > 1e-300
        safe = np.where(sound, diagonal, 1.0)
        cos_old, sin_old, cos, sin = cos, sin, np.where(sound, r1 / safe, 1.0), np.where(sound, next_length / safe, 0.0)
        w_old, w = w, np.where(sound, (v - r3 * w_old - r2 * w) / safe, 0.0)
        x += cos * eta * w
        eta = -sin * eta
        if np.all(np.abs(eta) <= relative * start):
            break
        v_old, v = v, np.where(next_length > 1e-300, fresh / np.where(next_length > 0, next_length, 1.0), 0.0)
        length = next_length
    return x


def _outside(block: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """Orthonormal basis of what ``block`` has outside the given orthonormal bases."""
    lengths = np.linalg.norm(block, axis=0)
    block = block[:, lengths > 0] / lengths[lengths > 0]
    kept: list[np.ndarray] = []
    for column in block.T:
        for _ in range(3):
            for basis in (*bases, np.array(kept).T if kept else np.zeros((len(column), 0))):
                column = column - basis @ (basis.T @ column)
        size = np.linalg.norm(column)
        if size > 1e-10:
            column = column / size
            for basis in (*bases, np.array(kept).T if kept else np.zeros((len(column), 0))):
                column = column - basis @ (basis.T @ column)
            kept.append(column / np.linalg.norm(column))
    return np.array(kept).T if kept else np.zeros((block.shape[0], 0))


def jacobi_davidson(product, d: int, wanted: int, tolerance: float = TOLERANCE, inner: int = INNER_STEPS,
                    seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Largest ``wanted`` eigenvalues (falling) and unit eigenvectors of a symmetric operator.

    ``product`` maps a (d, b) block to the operator times the block. The search
    space holds at most ``4 * wanted`` vectors and restarts from its best ones.
    """
    random = np.random.default_rng(seed)
    wanted = min(wanted, d)
    room = min(d, 4 * wanted)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = _outside(random.standard_normal((d, wanted)))
    image = product(space)
    for _ in range(MAX_ROUNDS):
        theta, turn = np.linalg.eigh((space.T @ image + image.T @ space) / 2)
        order = np.argsort(theta)[::-1]
        theta, space, image = theta[order], space @ turn[:, order], image @ turn[:, order]
        open_pairs = min(wanted - locked.shape[1], space.shape[1])
        rest = image - space * theta
        rest -= locked @ (locked.T @ rest)
        largest = max(abs(theta[0]), abs(values[0]) if len(values) else 0.0)
        good = np.linalg.norm(rest, axis=0) <= tolerance * largest
        n = int(np.argmin(np.append(good[:open_pairs], False)))
        if n:
            locked, values = np.hstack([locked, space[:, :n]]), np.append(values, theta[:n])
            space, image, theta, rest = space[:, n:], image[:, n:], theta[n:], rest[:, n:]
            open_pairs -= n
        if locked.shape[1] == wanted:
            order = np.argsort(values)[::-1]
            return values[order], locked[:, order]
        if space.shape[1] + max(open_pairs, 1) > room - locked.shape[1]:
            keep = max(2 * open_pairs, 1) if room < d else space.shape[1]
            space, image = space[:, :keep], image[:, :keep]
        best, shift = space[:, :open_pairs], theta[:open_pairs]
        fixed = np.hstack([locked, best])

        def projected(block):
            block = block - fixed @ (fixed.T @ block)
            block = product(block) - block * shift
            return block - fixed @ (fixed.T @ block)

        corrections = _minres(projected, -rest[:, :open_pairs], inner, 0.05)
        fresh = _outside(corrections, locked, space)
        if not fresh.shape[1] and space.shape[1] + locked.shape[1] < d:
            fresh = _outside(random.standard_normal((d, 1)), locked, space)
        if fresh.shape[1]:
            fresh = fresh[:, :d - locked.shape[1] - space.shape[1]]
            space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
        else:  # the space is complete: refresh its image to remove old rounding
            space = _outside(space, locked)
            image = product(space)
    raise RuntimeError(f"residuals stayed above {tolerance} after {MAX_ROUNDS} rounds")


def fit(vectors: DataFrame, components: int = COMPONENTS, tolerance: float = TOLERANCE) -> Whitening | None:
    """Components of the covariance (divisor n) of the distinct vectors ``x`` of ``vectors``.

    None if there is no vector. Components whose eigenvalue is zero to rounding
    (fewer distinct vectors than dimensions, constant dimensions) are left out.
    """
    distinct = materialise(vectors.select("x").distinct())
    counted = _sums(distinct, _counted)
    if counted is None:
        return None
    n, sums = int(counted[0, 1]), counted[:, 0]
    centre, d = Centre(n, sums), len(sums)
    distinct = distinct.coalesce(max(1, n * d * 8 // PART_BYTES))

    def product(block: np.ndarray) -> np.ndarray:
        def part(x):
            c = centre(x)
            return c.T @ (c @ block)

        return _sums(distinct, part) / n

    trace = float(_sums(distinct, lambda x: (centre(x) ** 2).sum()) / n)
    if trace == 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    values, basis = jacobi_davidson(product, d, components, tolerance)
    keep = values > RANK * values[0]
    values, basis = values[keep], basis[:, keep]
    mapping = basis / np.sqrt(values)

    def squares(x):
        z = centre(x) @ mapping
        return z.T @ z

    error = np.abs(_sums(distinct, squares) / n - np.eye(len(values))).max()
    return Whitening(n, sums, values, basis, trace, float(error))


def whiten(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error.

    ``vectors`` has ``id`` and ``x`` as :func:`quantised` makes them. Repeated
    rows give repeated results, a null id stays; without a model, or where all
    fitted vectors are equal, there are no components and so no rows.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    schema = (f"id {kind}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    centre, k = Centre(model.n, model.sums), len(model.values)
    mapping = model.vectors / np.sqrt(model.values)
    explained = model.values / model.trace
    names = ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1))
            m = len(x)
            columns = (np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, model.n, dtype=np.int64),
                       np.repeat(centre.deviations(x), k), (centre(x) @ mapping).ravel(), np.tile(explained, m),
                       np.full(m * k, model.identity_error))
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], names)

    return arrow_pass(vectors.select("id", "x"), run, schema)
