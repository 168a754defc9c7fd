"""Embedding whitening by shifted CholeskyQR (op 13).

The centred rows A of the fit list are never written: a pass computes them from the integers, solves them against the
triangular factors found so far and sums the Gram matrix of the result within partitions. The Cholesky factor of a Gram matrix is the
next triangular factor; the first matrix is shifted so that it exists whatever the condition of A. After two or three passes
the rows are orthonormal, A = Q R with R the product of the factors, and the singular values and vectors of R (dimensions squared)
are those of A: eigenvectors of the covariance with the precision of A itself, not of its square.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklore.llm.common import Scratch, matrix_sum, stored, with_arrow

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Gram passes at most; how near to the identity the last one is.
PASSES, NEAR = 6, 1e-7
#: Integers beyond this take no part, as entries that are not finite.
LARGEST = 1 << 52
_UNIT = np.finfo(np.float64).eps / 2


def integers_of(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """``floor(scale * c) + offset`` per entry; null if the vector or an entry is null or not finite, or scale * c is 2^52 or more."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * scale) >= LARGEST))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad,
                  F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long") + offset))


@dataclass
class Whitening:
    """n and the sums of the fit list; the eigenvectors (columns) and eigenvalues of its covariance."""
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S as exact integers: of 64 bits where they fit, else Python's."""
    middle = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64)
    off = x - middle
    if len(off) and float(np.abs(off).max()) * n + n >= 2.0 ** 62:
        return off.astype(object) * n - rest.astype(object)
    return off * n - rest


def _matrix(column: pa.Array) -> np.ndarray:
    rows = pa.concat_arrays([column])
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, rounded once."""
    return (deviations(x, n, sums) / n).astype(np.float64)


def solved(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """a R1^-1 R2^-1 ... for upper triangular factors, by substitution column by column."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(a.shape[1]):
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (x: array<long> of one length, distinct, stored); None without rows."""
    first = vectors.select(F.size("x").alias("p")).first()
    if first is None:
        return None
    p = first["p"]
    seen = vectors.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(p)]).first()
    n, sums = seen["n"], [int(seen[f"s{i}"]) for i in range(p)]
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        def gram(batch: pa.RecordBatch, known=tuple(factors)) -> np.ndarray:
            q = solved(centred(_matrix(batch.column(0)), n, sums), known)
            return q.T @ q

        g = matrix_sum(vectors.select("x"), gram, (p, p))
        g = (g + g.T) / 2
        if not k:
            size = float(np.trace(g))
            if size == 0:                           # all rows are equal
                return Whitening(n, sums, np.zeros((p, 0)), np.zeros(0), 0.0)
            factors.append(np.linalg.cholesky(g + 11 * p * (p + 1) * _UNIT * size * np.eye(p)).T)
            continue
        low, axes = np.linalg.eigh(g)
        if low[0] <= p * _UNIT * 100 * low[-1] or k == PASSES - 1:
            # Directions without variance stay of length zero in all passes: the symmetric root closes the product.
            factors.append((axes * np.sqrt(np.maximum(low, 0))) @ axes.T)
            break
        factors.append(np.linalg.cholesky(g).T)
        if np.abs(g - np.eye(p)).max() <= NEAR:
            break
    r = factors[0]
    for f in factors[1:]:
        r = f @ r
    _, singular, axes = np.linalg.svd(r)
    values = singular ** 2 / n
    found = int((singular > singular[0] * 1e-7).sum())     # the others are rounding
    axes = axes[:min(found, components)].T
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)   # one sign for all runs
    fitted = Whitening(n, sums, axes, values[:axes.shape[1]], float(values.sum()))

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = whiten(_matrix(batch.column(0)), fitted)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    m = axes.shape[1]
    sums_of = matrix_sum(vectors.select("x"), moments, (m + 1, m))
    mean = sums_of[-1] / n
    fitted.identity_error = float(np.abs(sums_of[:-1] / n - np.outer(mean, mean) - np.eye(m)).max())
    return fitted


def whiten(x: np.ndarray, fitted: Whitening) -> np.ndarray:
    return centred(x, fitted.n, fitted.sums) @ fitted.vectors / np.sqrt(fitted.values)


def whitened(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of every remaining row and component.

    Rows whose vector is null, empty, or holds entries that are null or not finite (or 2^46 and more) are dropped; of vectors of
    several lengths the most frequent length remains (of equally frequent ones the greater). The fit list has every different vector once, so
    repeated rows change nothing and come back as often. Null ids remain. Directions without variance are no components: there
    may be fewer than ``components``, with equal rows or none there are none, and no output. deviation is null where it does not
    fit 64 bits. Other columns of ``rows`` play no part.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    kept = stored(rows.select(F.col(vec_id).alias("vec_id"), integers_of(F.col(vector)).alias("x")).filter("x IS NOT NULL"))
    lengths = kept.groupBy(F.size("x").alias("p")).count().orderBy(F.desc("count"), F.desc("p")).first()
    fitted = None
    if lengths is not None:
        kept = kept.filter(F.size("x") == lengths["p"])
        fitted = fit(scratch(kept.select("x").distinct()), components)
        scratch.clear()
    if fitted is None or not len(fitted.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")

    def run(batch: pa.RecordBatch) -> dict:
        x = _matrix(batch.column(0))
        d = deviations(x, fitted.n, fitted.sums)
        if d.dtype == object or float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] >= 2.0 ** 62:
            exact = [sum(v * v for v in r) for r in d.tolist()]
            deviation = [v if v < 1 << 63 else None for v in exact]
        else:
            deviation = (d * d).sum(axis=1)
        w = whiten(x, fitted)
        return {"deviation": pa.array(deviation, pa.int64()), "w": pa.array(list(w), pa.list_(pa.float64()))}

    share = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values])
    made = with_arrow(kept, run, {"deviation": "long", "w": "array<double>"}, ["x"], ["vec_id"])
    return (made.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened"))
            .select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(share, F.col("i") + 1).alias("explained"), F.lit(fitted.identity_error).alias("identity_error")))
