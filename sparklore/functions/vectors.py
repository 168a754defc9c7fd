"""Vectors as array columns, and packed blocks of vectors for matrix products inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if the sizes differ or one side is missing or empty."""
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0),
                  dot(a, b) / (norm(a) * norm(b) + 1e-9)).otherwise(0.0)


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: F.abs(x) > 1e-9)


def align(v: Column, d: int) -> Column:
    """Cut or fill with zeros to ``d`` values; a missing vector becomes zeros."""
    zeros = F.array_repeat(F.lit(0.0), d)
    values = F.transform(v, lambda x: x.cast("double"))
    return F.slice(F.concat(F.coalesce(values, F.array().cast("array<double>")), zeros), 1, d)


def parse_vector(text: Column) -> Column:
    """``"[v1,v2]"`` to an array; malformed text gives NULL."""
    return F.when(F.try_parse_json(text).isNotNull() & text.endswith("]"), F.from_json(text, "array<double>"))


def pack_blocks(df: DataFrame, keys: list[str], id_col: str, vec_col: str, rows: int = 1024) -> DataFrame:
    """Blocks of up to ``rows`` vectors of equal keys, packed where the rows already lie.

    Columns: keys, ids (array), dim, data (float64 bytes, row-major), center (unit vector
    bytes), radius (largest angle to the center). A narrow operation.
    """
    types = dict(df.select(*keys).dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + \
        ", ids array<string>, dim int, data binary, center binary, radius double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf[vec_col].notna()]
            out = []
            dims = pdf[vec_col].map(len)
            for key, part in pdf.groupby([*[pdf[k] for k in keys], dims], sort=False):
                if key[-1] == 0:
                    continue
                for lo in range(0, len(part), rows):
                    piece = part.iloc[lo:lo + rows]
                    m = np.asarray(piece[vec_col].tolist(), dtype=np.float64)
                    unit = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-12)
                    center = unit.mean(axis=0)
                    center = center / (np.linalg.norm(center) + 1e-12)
                    radius = float(np.arccos(np.clip(unit @ center, -1.0, 1.0)).max())
                    out.append([*key[:-1], piece[id_col].astype(str).tolist(), int(m.shape[1]),
                                m.tobytes(), center.tobytes(), radius])
            if out:
                yield pd.DataFrame(out, columns=[*keys, "ids", "dim", "data", "center", "radius"])

    return df.select(*keys, id_col, vec_col).mapInPandas(run, schema)


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.float64).reshape(-1, int(dim))


def block_matches(pairs: DataFrame, keys: list[str], *, threshold: float | None = None,
                  top_k: int | None = None, eps: float = 0.0) -> DataFrame:
    """Cosine of the vectors of two joined blocks (columns prefixed ``a_`` and ``b_``).

    ``eps`` is added to the product of the norms; a zero vector has similarity 0.

    Only rows above ``threshold``, and only the ``top_k`` best of each a-vector in the block
    pair, leave the task; ties are kept by the smaller b-id.
    """
    types = dict(pairs.select(*keys).dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", a_id string, b_id string, sim double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                a, b = _matrix(row.a_data, row.a_dim), _matrix(row.b_data, row.b_dim)
                na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                norms = np.outer(na, nb) + eps
                sim = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)
                a_ids, b_ids = np.asarray(row.a_ids, dtype=object), np.asarray(row.b_ids, dtype=object)
                if threshold is not None and top_k is None:
                    i, j = np.nonzero(sim > threshold)
                else:
                    # Keep every value not below the k-th best, so that equal values of
                    # other blocks can still win their tie.
                    k = min(top_k, sim.shape[1])
                    kth = -np.partition(-sim, k - 1, axis=1)[:, k - 1:k]
                    keep = sim >= kth - 1e-12
                    if threshold is not None:
                        keep &= sim > threshold
                    i, j = np.nonzero(keep)
                if len(i):
                    yield pd.DataFrame({**{key: getattr(row, key) for key in keys},
                                        "a_id": a_ids[i], "b_id": b_ids[j], "sim": sim[i, j]})

    return pairs.mapInPandas(run, schema)


@F.pandas_udf(DoubleType())
def _block_angle(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([float(np.arccos(np.clip(np.frombuffer(x) @ np.frombuffer(y), -1.0, 1.0)))
                      if len(x) == len(y) else 10.0 for x, y in zip(a, b)], dtype="float64")


def join_blocks(a: DataFrame, b: DataFrame, keys: list[str], salts: int = 16,
                min_cosine: float | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Pairs of blocks with equal keys and dimension; a side of at most ``broadcast_bytes`` is broadcast,
    beyond that both are spread over ``salts`` sub-keys.

    The b-blocks are split by salt, the a-blocks are copied to each, so that one hot key is
    worked on by many tasks. With ``min_cosine`` pairs are left out whose centers are so far
    apart that, by the triangle inequality on angles, no two members can be that similar.
    """
    if min_cosine is None and (a.agg(F.sum(F.octet_length("data"))).first()[0] or 0) <= broadcast_bytes:
        # The a-side is small by its measured bytes: it goes to every task, and the b-blocks are not moved.
        left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("ids", "dim", "data", "center", "radius")])
        right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("ids", "dim", "data", "center", "radius")])
        return right.join(F.broadcast(left), keys).filter("a_dim = b_dim")
    left = a.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ("ids", "dim", "data", "center", "radius")],
                    F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    right = b.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ("ids", "dim", "data", "center", "radius")],
                     F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(salts)).cast("int").alias("_salt"))
    pairs = left.join(right, [*keys, "_salt"]).filter("a_dim = b_dim")
    if min_cosine is not None:
        reach = float(np.arccos(min_cosine)) + 1e-9
        pairs = pairs.filter(_block_angle("a_center", "b_center") <= F.col("a_radius") + F.col("b_radius") + reach)
    return pairs.drop("_salt")
