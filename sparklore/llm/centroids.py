"""Centroid clustering of integer vectors by scalar lookup tables (op 12).

Each component is an integer, and few integers occur in a dimension. So vectors are stored as numbers of (dimension, value)
pairs, and a round tabulates the squared difference of every occurring pair to every centroid. A distance
is the sum of one table row per dimension: NumPy gathers and additions, without a multiplication per vector. Sums and
counts of the clusters are formed within partitions first; centroids (k times the dimensions) are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklore.llm.common import SLICE, Scratch, of_worker, stored, with_arrow

SCALE, DIMENSIONS, K, ROUNDS = 64, 64, 16, 3
#: Occurring (dimension, value) pairs up to which one table serves all tasks; beyond it, tables are made per batch.
PAIRS = 200_000
#: Components beyond this would overflow a squared distance of 64 bits.
LARGEST = 1 << 27


def integers_of(vector: Column, scale: int = SCALE, dimensions: int = DIMENSIONS) -> Column:
    """``floor(scale * x)`` per component as long; null if the vector has not exactly ``dimensions`` components, if one is null or
    not finite, or if its integer is beyond ``LARGEST`` (2^27: a squared distance would not fit 64 bits)."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) >= LARGEST))
    return F.when(vector.isNotNull() & (F.size(vector) == dimensions) & ~bad, F.transform(scaled, lambda x: x.cast("long")))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    rows = pa.concat_arrays([column])
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def occurring(vectors: DataFrame, dimensions: int, most: int = PAIRS) -> list[np.ndarray] | None:
    """The sorted values of each dimension of ``vectors`` (x), or None if there are more than ``most`` pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dimensions)
                values = [np.unique(x[:, d]) for d in range(dimensions)]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(dimensions, dtype=np.int32), [len(v) for v in values])),
                                                  pa.array(np.concatenate(values))], names=["d", "value"])

    pairs = vectors.select("x").mapInArrow(run, "d int, value long").distinct().limit(most + 1).collect()
    if len(pairs) > most:
        return None
    out: list[list[int]] = [[] for _ in range(dimensions)]
    for d, value in pairs:
        out[d].append(value)
    return [np.array(sorted(v), np.int64) for v in out]


def numbered(x: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Row numbers of the table instead of the values of ``x``."""
    first = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return np.stack([first[d] + np.searchsorted(v, x[:, d]) for d, v in enumerate(values)], axis=1)


def squares(values: list[np.ndarray], centroids: np.ndarray) -> np.ndarray:
    """One row per (dimension, occurring value), one column per centroid: the squared difference."""
    return np.concatenate([(v[:, None] - centroids[None, :, d]) ** 2 for d, v in enumerate(values)])


def nearest(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid; of equal distances the smaller number."""
    total = np.zeros((len(codes), table.shape[1]), np.int64)
    for d in range(codes.shape[1]):
        total += table[codes[:, d]]
    best = total.argmin(axis=1)
    return best.astype(np.int32), total[np.arange(len(best)), best]


def start(vectors: DataFrame, k: int, seed: str = "1") -> np.ndarray:
    """The ``k`` vectors (vec_id, x) with the smallest sha256 of ``seed:vec_id``, in that order; null ids last, equal ids by x."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def cluster(rows: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", k: int = K, rounds: int = ROUNDS,
            scale: int = SCALE, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row whose vector takes part (``integers_of``).

    Centroids start as the k first rows by hash and move ``rounds`` times to the floor of their cluster's mean; empty clusters
    stay. Rows that are repeated count as often and come back as often; null ids take part. Fewer than k rows give fewer
    centroids, no rows no rows. Other columns play no part. Inertias are null where they do not fit 64 bits.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    kept = scratch(rows.select(F.col(vec_id).alias("vec_id"), integers_of(F.col(vector), scale, dimensions).alias("x")).filter("x IS NOT NULL"))
    centroids = start(kept, k)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    values = occurring(kept, dimensions)
    coded = kept
    if values is not None:          # numbers instead of values, once; they are the same in all rounds
        def number(batch: pa.RecordBatch) -> dict:
            codes = numbered(_matrix(batch.column(0), dimensions), values)
            return {"x": pa.array(list(codes.astype(np.int32)), pa.list_(pa.int32()))}

        coded = scratch(with_arrow(kept, number, {"x": "array<int>"}, ["x"], ["vec_id"]))
        flat = np.concatenate(values)

    def placed(column: pa.Array, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vectors of a batch, and the nearest centroid and distance of each."""
        x = _matrix(column, dimensions)
        if values is None:
            own = [np.unique(x[:, d]) for d in range(dimensions)]
            return x, *nearest(numbered(x, own), squares(own, now))
        table = of_worker(("squares", now.tobytes(), len(flat)), lambda: squares(values, now))
        return flat[x], *nearest(x, table)

    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], now=centroids) -> Iterator[pa.RecordBatch]:
            count, total = np.zeros(len(now), np.int64), np.zeros(now.shape, np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, SLICE):
                    x, best, _ = placed(whole.slice(at, SLICE).column(0), now)
                    count += np.bincount(best, minlength=len(now))
                    for c in np.unique(best):
                        total[c] += x[best == c].sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(now)), pa.int32()), pa.array(count), pa.array(list(total), pa.list_(pa.int64()))],
                                             names=["cluster", "n", "total"])

        parts = coded.select("x").mapInArrow(sums, "cluster int, n long, total array<long>")
        found = (parts.select("cluster", "n", F.posexplode("total").alias("d", "total")).groupBy("cluster", "d")
                 .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(20,0)")).alias("total")).filter("n > 0").collect())
        moved = centroids.copy()
        for r in found:
            moved[r["cluster"], r["d"]] = int(r["total"]) // r["n"]
        centroids = moved

    def assign(batch: pa.RecordBatch, now=centroids) -> dict:
        _, best, distance = placed(batch.column(0), now)
        return {"cluster": best, "distance": distance}

    assigned = stored(with_arrow(coded, assign, {"cluster": "int", "distance": "long"}, ["x"], ["vec_id"], state=True))
    scratch.clear()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"))
    own = {r["cluster"]: int(r["own"]) for r in inertia.collect()}      # k numbers
    per = [own.get(c, 0) for c in range(len(sha))]

    def of(values: list[Column]) -> Column:
        """The value of a row's cluster."""
        return F.element_at(F.array(*values), F.col("cluster") + 1)

    def fitting(v: int) -> Column:
        return F.lit(v if v < 1 << 63 else None).cast("long")

    return assigned.select("vec_id", "cluster", "distance", of([fitting(v) for v in per]).alias("cluster_inertia"),
                           fitting(sum(per)).alias("inertia"), of([F.lit(s) for s in sha]).alias("centroid_sha256"))
