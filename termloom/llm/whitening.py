"""Whitening of embeddings by the leading eigenvectors of their covariance, found with Jacobi-Davidson.

The covariance is never formed: a Spark job multiplies it with a block of vectors, ``(1/n) sum (x - m) ((x - m) . w)``, in
one pass over the rows. The driver keeps a search space of a few dozen vectors of the embeddings' width. Each outer step
takes Ritz pairs from it, solves the projected correction equation of every pair that isn't there yet by inner MINRES (all of
them side by side, so that a step is one job), and extends the space. A pair is locked, and projected out of what follows,
once its residual is as small as double precision lets it be.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored

#: Integer steps of one unit; components kept.
SCALE = 256
COMPONENTS = 4
#: Entries beyond this size (in steps) count as non-finite.
LARGEST = 1 << 31
#: Search space: vectors to begin with, most of them, and left at a restart (beside those wanted).
FIRST, MOST, LEFT = 8, 40, 12
#: Outer steps, inner steps of one correction.
OUTER, INNER = 60, 8
#: A residual this small, relative to the largest eigenvalue, is that of a pair exact to double precision.
PRECISION = 2e-14
#: Residuals that have stopped falling are taken below this; above, the search has failed.
SETTLED = 1e-11
#: Eigenvalues below this share of the trace are rounding.
RANK = 1e-12

Product = Callable[[np.ndarray], np.ndarray]


def orthonormal(v: np.ndarray, *spaces: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of ``v`` after the other spaces are taken away, without what is left of nothing."""
    out = np.zeros((len(v), 0))
    for c in v.T:
        size = np.linalg.norm(c)
        for _ in range(3):
            for s in (*spaces, out):
                c = c - s @ (s.T @ c)
        left = np.linalg.norm(c)
        if left > 1e-10 * size and left > 0:
            c = c / left
            for s in (*spaces, out):
                c = c - s @ (s.T @ c)
            out = np.hstack([out, (c / np.linalg.norm(c))[:, None]])
    return out


def minres(apply: Product, rhs: np.ndarray, steps: int, reduce: float) -> np.ndarray:
    """Approximate solutions of symmetric, maybe indefinite systems, a column each, that share every call of ``apply``.
    Ends when all residuals have fallen by ``reduce``."""
    beta = np.linalg.norm(rhs, axis=0)
    start, safe = beta.copy(), lambda a: np.where(a == 0, 1, a)
    x, v_old, v = np.zeros_like(rhs), np.zeros_like(rhs), rhs / safe(beta)
    d_old, d_older = np.zeros_like(rhs), np.zeros_like(rhs)
    c_old, c, s_old, s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    eta, beta_old = beta.copy(), np.zeros_like(beta)
    for _ in range(steps):
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        new = av - alpha * v - beta_old * v_old
        beta_new = np.linalg.norm(new, axis=0)
        # The last column of the tridiagonal matrix under the rotations so far, and the next rotation.
        over, off = s_old * beta_old, c_old * beta_old
        diagonal, off = c * alpha - s * off, s * alpha + c * off
        r = np.hypot(diagonal, beta_new)
        c_old, s_old = c, s
        c, s = diagonal / safe(r), beta_new / safe(r)
        d = np.where(r > 0, (v - off * d_old - over * d_older) / safe(r), 0)
        x = x + c * eta * d
        eta = -s * eta
        d_older, d_old = d_old, d
        done = beta_new <= 1e-15 * safe(start)
        v_old, v, beta_old = v, np.where(done, 0, new / safe(beta_new)), np.where(done, 0, beta_new)
        if np.all(np.abs(eta) <= reduce * start):
            break
    return x


@dataclass(frozen=True)
class Pairs:
    """Eigenvalues, falling, with unit eigenvectors as columns; largest residual; products asked for."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    products: int


def leading_pairs(product: Product, width: int, wanted: int, seed: int = 7) -> Pairs:
    """The ``wanted`` largest eigenpairs of a symmetric, positive semidefinite matrix, given by its products."""
    wanted = min(wanted, width)
    calls = [0]

    def times(v: np.ndarray) -> np.ndarray:
        calls[0] += 1
        return product(v)

    rng = np.random.default_rng(seed)
    locked, values = np.zeros((width, 0)), []
    w = orthonormal(rng.standard_normal((width, min(FIRST, width))))
    aw = times(w)
    w2 = orthonormal(aw, w)  # one step of a block Krylov space: what is large comes up at once
    if w2.shape[1]:
        w, aw = np.hstack([w, w2]), np.hstack([aw, times(w2)])
    last, stalled, worst, top = np.inf, 0, 0.0, 0.0
    for outer in range(OUTER):
        h = w.T @ aw
        theta, s = np.linalg.eigh((h + h.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        u, au = w @ s, aw @ s
        top = max(top, theta[0] if len(theta) else 0.0, *values, 0.0)
        open_ = max(wanted - len(values), 1)
        r = au[:, :open_] - u[:, :open_] * theta[:open_]
        r = r - locked @ (locked.T @ r)
        sizes = np.linalg.norm(r, axis=0)
        goal = PRECISION * top
        # Lock from the largest on, so that order and deflation agree; rounding may hold residuals a little above.
        stalled = stalled + 1 if sizes.size and sizes.max() > 0.5 * last else 0
        last = min(last, sizes.max()) if sizes.size else last
        limit = SETTLED * top if stalled >= 4 else goal
        n_done = 0
        while n_done < open_ and n_done < len(theta) and sizes[n_done] <= limit:
            n_done += 1
        if n_done:
            worst = max(worst, float(sizes[:n_done].max()))
            values += theta[:n_done].tolist()
            locked = np.hstack([locked, u[:, :n_done]])
            w, aw, theta = u[:, n_done:], au[:, n_done:], theta[n_done:]
            u, au, r, sizes = w, aw, r[:, n_done:], sizes[n_done:]
            last, stalled = np.inf, 0
        # A Ritz value never exceeds its eigenvalue: one above the smallest wanted shows that a pair was passed over.
        if len(values) >= wanted and not (len(theta) and theta[0] > sorted(values)[-wanted] * (1 + SETTLED)):
            break
        open_ = min(max(wanted - len(values), 1), u.shape[1])
        if u.shape[1] + open_ > MOST:
            keep = LEFT + open_
            u, au, theta = u[:, :keep], au[:, :keep], theta[:keep]
        w, aw = u, au
        t, shift = r[:, :open_], theta[:open_]
        near = u[:, :open_]

        def project(v: np.ndarray) -> np.ndarray:
            v = v - locked @ (locked.T @ v)
            return v - near * (near * v).sum(axis=0)

        correction = minres(lambda v: project(times(v) - v * shift), -project(t), INNER, 2.0 ** -(outer + 2))
        more = orthonormal(np.hstack([project(correction), t]), locked, w)[:, : max(open_, 1)]
        if not more.shape[1]:
            more = orthonormal(rng.standard_normal((width, open_)), locked, w)
        if more.shape[1]:
            w, aw = np.hstack([w, more]), np.hstack([aw, times(more)])
        else:  # the whole space is spanned: the Ritz pairs are as good as they get
            stalled = 4
    else:
        raise RuntimeError(f"eigenpairs did not settle: residuals {sizes / max(top, 1e-300)}")
    order = np.argsort(-np.array(values), kind="stable")[:wanted]
    return Pairs(np.array(values)[order], locked[:, order], worst / top if top else 0.0, calls[0])


def _rows(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _partial(fold: Callable[[np.ndarray], np.ndarray]):
    """The sum of ``fold(rows)``, one flat array, over a partition; an entry a row."""
    schema = pa.schema([("i", pa.int32()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = fold(_rows(batch)).ravel()
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], schema=schema)

    return run


def summed(fit: DataFrame, fold: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """``fold`` summed over all rows; ``size`` numbers reach the driver."""
    found = fit.select("x").mapInArrow(_partial(fold), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def covariance_product(fit: DataFrame, n: int, mean: np.ndarray) -> Product:
    def product(v: np.ndarray) -> np.ndarray:
        def fold(rows: np.ndarray) -> np.ndarray:
            centred = rows - mean
            return centred.T @ (centred @ v)

        return summed(fit, fold, v.size).reshape(v.shape) / n

    return product


def steps(embedding: Column) -> Column:
    """Entries as whole steps, rounded down."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE))


def usable(embedding: Column) -> Column:
    """Not null or empty, all entries finite, and small enough to be counted in 32 bits."""
    limit = float(LARGEST) / SCALE
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (c >= limit) | (c < -limit))
    return F.coalesce((F.size(embedding) > 0) & ~bad, F.lit(False))


SCHEMA = "vec_id long, component int, deviation long, whitened double"


def _projected(n: int, sums: list[int], pairs: Pairs):
    """Rows of ``SCHEMA``: every vector with each component."""
    mean, k = np.array(sums, dtype=np.float64) / n, len(pairs.values)
    to = pairs.vectors / np.sqrt(pairs.values)
    total = max(map(abs, sums), default=0)
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, dtype=object)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _rows(batch)
            largest = n * int(np.abs(rows).max()) + total
            if largest * largest * len(sums) < 1 << 63:
                off = n * rows.astype(np.int64) - exact.astype(np.int64)
                deviation = (off * off).sum(axis=1)
            else:  # beyond 64 bits inside; the sum itself may still fit
                off = n * rows.astype(np.int64).astype(object) - exact
                deviation = [d if d < 1 << 63 else None for d in (off * off).sum(axis=1)]
            white = (rows - mean) @ to
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(rows)), k)))
            at = np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))
            columns = [ids, pa.array(at), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(rows)), k)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(white.ravel())], schema=schema)

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error, residual`` of ``vectors (vec_id, embedding)``.

    Entries become whole steps of 1/256, rounded down. Mean and covariance are those of the distinct vectors, ``n`` of
    them; every usable row is projected, repeated rows and null ids too. ``deviation`` is the exact sum of
    ``(n x - S)^2``, null where it is beyond 64 bits; ``explained`` the component's share of the variance; ``residual``
    the largest relative residual of the eigenpairs.

    Rows whose vector is null, empty, or has an entry that is null, not finite or beyond 2^23 in size, are dropped, also
    those of another width than the vector of the smallest id. Components without variance (fewer distinct vectors than
    components, one vector alone) are left out, so that an empty table, or equal vectors only, give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.where(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), steps(F.col("embedding")).cast("array<int>").alias("x")
    )
    empty = rows.select(
        "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
        *(F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error", "residual")),
    ).where(F.lit(False))
    least = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select(F.size("x").alias("w")).limit(1).collect()
    if not least:
        return empty
    width = least[0]["w"]
    rows = rows.where(F.size("x") == width)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    sums = F.array(*(F.sum(F.col("x")[i].cast("long")) for i in range(width)))
    one = fit.agg(F.count(F.lit(1)).alias("n"), sums.alias("sums")).first()
    n, totals = one["n"], list(one["sums"])
    mean = np.array(totals, dtype=np.float64) / n
    trace = float(summed(fit, lambda r: np.square(r - mean).sum(axis=0), width).sum()) / n
    if trace <= 0:
        return empty
    pairs = leading_pairs(covariance_product(fit, n, mean), width, components)
    real = pairs.values > RANK * trace
    pairs = Pairs(pairs.values[real], pairs.vectors[:, real], pairs.residual, pairs.products)
    to, k = pairs.vectors / np.sqrt(pairs.values), len(pairs.values)

    def moments(r: np.ndarray) -> np.ndarray:
        white = (r - mean) @ to
        return np.concatenate([white.sum(axis=0), (white.T @ white).ravel()])

    seen = summed(fit, moments, k + k * k) / n
    error = float(np.abs(seen[k:].reshape(k, k) - np.outer(seen[:k], seen[:k]) - np.eye(k)).max())
    explained = F.element_at(F.array(*(F.lit(float(e / trace)) for e in pairs.values)), F.col("component"))
    return rows.mapInArrow(_projected(n, totals, pairs), SCHEMA).select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"),
        F.lit(error).alias("identity_error"), F.lit(pairs.residual).alias("residual"),
    )
