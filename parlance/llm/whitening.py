"""Whitening of embeddings by their principal components.

Tasks sum what is needed of the distinct vectors, first the vector sum, then the scatter of centred
vectors. The driver, which holds no more than one number for each pair of dimensions, factors the
covariance by Cholesky with pivots and rotates the columns of the triangular factor by one-sided Jacobi
until they are orthogonal: their norms, squared, are the eigenvalues, and the normalised columns the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored

#: entries of vectors are read in steps of 1 / STEPS, and moved up by OFFSET
STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def cholesky_with_pivots(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): the rows ``order`` of ``v`` (symmetric, no negative eigenvalues) are ``factor @ factor.T``; the factor has as many columns as ``v`` has rank."""
    d = len(v)
    a, order, left = v.astype(float), np.arange(d), np.diag(v).astype(float)
    low, least = np.zeros((d, d)), d * np.finfo(float).eps * max(left.max(initial=0.0), 0.0)
    for k in range(d):
        j = k + int(left[k:].argmax())
        if not left[j] > least:
            return low[:, :k], order
        for x in (order, left, low, a):
            x[[k, j]] = x[[j, k]]
        a[:, [k, j]] = a[:, [j, k]]
        low[k, k] = np.sqrt(left[k])
        low[k + 1 :, k] = (a[k + 1 :, k] - low[k + 1 :, :k] @ low[k, :k]) / low[k, k]
        left[k + 1 :] -= low[k + 1 :, k] ** 2
    return low, order


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """``factor`` with its columns rotated, in pairs, until all are orthogonal. Pairs that share no column are rotated together, as in a round of a tournament."""
    cols = factor.T.copy()
    r = len(cols)
    seats = np.arange(r + r % 2)
    close = max(factor.shape[0], 1) * np.finfo(float).eps
    for _ in range(sweeps):
        moved = False
        for _ in range(max(len(seats) - 1, 0)):
            p, q = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            real = (p < r) & (q < r)
            p, q = p[real], q[real]
            x, y = cols[p], cols[q]
            a, b, g = (np.einsum("ij,ij->i", *z) for z in ((x, x), (y, y), (x, y)))
            turn = np.abs(g) > close * np.sqrt(a * b)
            if turn.any():
                moved = True
                p, q, x, y, a, b, g = (z[turn] for z in (p, q, x, y, a, b, g))
                zeta = (b - a) / (2 * g)
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = 1 / np.hypot(1, t)
                s = c * t
                cols[p], cols[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
            seats = np.r_[seats[0], seats[-1], seats[1:-1]]
        if not moved:
            break
    return cols.T


def principal_components(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of the covariance ``v``, by falling eigenvalue, as many as its rank; the largest entry of a component is positive."""
    factor, order = cholesky_with_pivots(v)
    cols = orthogonal_columns(factor)
    norms = np.sqrt((cols**2).sum(axis=0))
    falling = np.argsort(-norms, kind="stable")
    units = np.empty_like(cols)
    units[order] = cols / norms
    units = units[:, falling]
    return norms[falling] ** 2, units * np.sign(units[np.abs(units).argmax(axis=0), np.arange(units.shape[1])] if len(falling) else 1.0)


class Fit(NamedTuple):
    """What whitening needs: ``n`` distinct vectors, their sums, eigenvalues, components (columns) and shares of the variance."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.n * x - self.sums) / float(self.n)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def as_matrix(column: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length, without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def grid(vector: Column) -> Column:
    """Each entry c of a vector as floor(STEPS * c) + OFFSET; null for a vector that is null or has an entry that is null, not finite or beyond whole numbers of doubles."""
    steps = F.transform(vector, lambda c: c.cast("double") * STEPS)
    odd = F.exists(steps, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= float(1 << 52)))
    return F.when(~odd, F.transform(steps, lambda c: F.floor(c).cast("long") + OFFSET))


def gram(vectors: DataFrame, prepare: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of m.T @ m over ``m = prepare(rows of x)``, of ``width`` columns: each task adds up its own rows, then one number for each pair of columns is summed over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            m = prepare(as_matrix(b.column(0)))
            total += m.T @ m
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "v"])

    out = np.zeros((width, width))
    for r in vectors.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a row for each pair of columns
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"]
    return out


def fit(vectors: DataFrame, most: int = COMPONENTS) -> Fit:
    """The first ``most`` components of the distinct rows of ``vectors`` (x array<long>, all of one length, no nulls); none if all rows are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0, 0
        for b in batches:
            total, n = total + as_matrix(b.column(0)).sum(axis=0), n + b.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], names=["i", "s", "n"])

    found = vectors.select("x").mapInArrow(run, "i int, s long, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").collect()  # a row for each dimension
    none = Fit(0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    if not found:
        return none
    start = none._replace(n=found[0]["n"], sums=np.array([r["s"] for r in found]))
    v = gram(vectors, start.centred, len(found)) / start.n
    values, components = principal_components(v)
    return start._replace(values=values[:most], components=components[:, :most], explained=values[:most] / np.trace(v))


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened rows of ``vectors`` minus the identity."""
    k = len(model.values)
    sums = gram(vectors, lambda x: np.c_[model.whitened(x), np.ones(len(x))], k + 1) / model.n
    return float(np.abs(sums[:k, :k] - np.outer(sums[:k, k], sums[:k, k]) - np.eye(k)).max())


def deviations(x: np.ndarray, model: Fit) -> list[int | None]:
    """For each row the exact sum of (n x - S) squared; null beyond 64 bits."""
    away = model.n * x - model.sums
    if (away.astype(float) ** 2).sum(axis=1).max(initial=0) < 2.0**62:
        return (away * away).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in away.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(embeddings: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of ``embeddings`` (vec_id, ``vector`` array of numbers) and each component.

    Rows go whose vector is null or has an entry that is null, not finite or, times 64, beyond 2 to the 52;
    so do vectors of another length than most distinct ones have (the greater of equally frequent). Components come
    from distinct vectors, so repeated rows count once and each gets its rows. There are as many as the covariance
    has rank, so equal vectors, a single row and an empty table give no rows. Null and repeated ids are kept.
    ``deviation`` is null where it is no 64-bit number. Other columns are ignored.
    """
    whole = stored(embeddings.select("vec_id", grid(F.col(vector)).alias("x")).where("x is not null"), "vectors")
    distinct = stored(whole.select("x").distinct(), "distinct-vectors")
    usual = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    d = usual["d"] if usual else 0
    whole, distinct = (t.where(F.size("x") == d) for t in (whole, distinct))
    model = fit(distinct, most)
    k = len(model.values)
    error = identity_error(distinct, model) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches if k else ():
            x = as_matrix(b.column(1))
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), model.n)), pa.array(deviations(x, model), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(x))), pa.array(np.full(len(each), error)),
                ],
                names=["vec_id", *(c.split()[0] for c in SCHEMA.split(", "))],
            )

    kind = whole.schema["vec_id"].dataType.simpleString()
    return whole.mapInArrow(run, f"vec_id {kind}, {SCHEMA}")
