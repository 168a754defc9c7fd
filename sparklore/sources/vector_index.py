"""Stored blocks of vectors, and an exact search that opens only the blocks that can hold an answer.

A block has a center and a radius (the largest angle of a member to the center). By the triangle inequality on angles no member is
nearer to a question than the center's angle less the radius. So a question is first held against its few nearest
blocks, which gives a bound for its k-th best answer, and then only against blocks that can beat that bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklore.functions import vectors as vec
from sparklore.session import stored_table
from sparklore.sources.delta_log import DeltaLog

BLOCKS = "tenant_id string, block long, n int, dim int, ids array<string>, data binary, center binary, radius double"
#: Vectors per block; signs of components that vectors of a block share; nearest blocks of a question in the first pass.
BLOCK_ROWS, SIGNS, PROBE = 1024, 8, 4
#: Questions that meet a block at once, about.
QUESTIONS = 256
_EPS = 1e-9


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.log = DeltaLog(spark, path, BLOCKS, ["tenant_id", "block"], buckets=buckets)

    def exists(self) -> bool:
        return self.log.exists()

    def extend(self, items: DataFrame, id_col: str, vec_col: str, batch_id: int | None = None, rows: int = BLOCK_ROWS) -> None:
        """Adds vectors (tenant_id, id, vector). Vectors with the same signs in their first components share blocks."""
        signs = sum((F.when(F.coalesce(F.get(vec_col, F.lit(i)), F.lit(0.0)) > 0, 1 << i).otherwise(0) for i in range(SIGNS)), F.lit(0))
        placed = items.filter(F.col(vec_col).isNotNull()).select("tenant_id", signs.cast("int").alias("cell"), F.col(id_col).alias("id"), F.col(vec_col).alias("v"))
        near = placed.hint("rebalance", F.col("tenant_id"), F.col("cell")).sortWithinPartitions("tenant_id", "cell")
        blocks = vec.pack_blocks(near, ["tenant_id", "cell"], "id", "v", rows)
        self.log.append(blocks.select("tenant_id", F.xxhash64("ids", "data").alias("block"), F.size("ids").alias("n"), "dim", "ids",
                                      "data", "center", "radius"), batch_id)

    def bounds(self, questions: DataFrame) -> DataFrame:
        """tenant_id, qid, block, bound: the highest cosine that a member of the block can have. Reads centers only."""
        q = vec.pack_blocks(questions, ["tenant_id"], "qid", "vector", rows=QUESTIONS)
        heads = self.log.read(None).select("tenant_id", "block", F.col("dim").alias("b_dim"), "center", "radius")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    a = np.frombuffer(r.data).reshape(-1, int(r.dim))
                    angle = np.arccos(np.clip(a @ np.frombuffer(r.center) / np.linalg.norm(a, axis=1), -1.0, 1.0))
                    yield pd.DataFrame({"tenant_id": r.tenant_id, "qid": r.ids, "block": r.block,
                                        "bound": np.cos(np.maximum(0.0, angle - r.radius))})

        pairs = q.select("tenant_id", "ids", "dim", "data").join(heads, "tenant_id").filter("dim = b_dim")
        return pairs.select("tenant_id", "ids", "dim", "data", "block", "center", "radius").mapInPandas(
            run, "tenant_id string, qid string, block long, bound double")

    def _evaluated(self, pairs: DataFrame, questions: DataFrame, k: int, groups: int) -> DataFrame:
        """The k best members of a block for each of its questions, for ``pairs`` (tenant_id, qid, block); equal ones at the border stay."""
        texts = questions.select("tenant_id", "qid", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        asked = (pairs.join(texts, ["tenant_id", "qid"])
                 .groupBy("tenant_id", "block", F.pmod(F.xxhash64("qid"), F.lit(groups)).alias("part"))
                 .agg(F.collect_list(F.struct("qid", "vector")).alias("questions")))     # QUESTIONS, about

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    a, b = np.array([x["vector"] for x in r.questions]), np.frombuffer(r.data).reshape(-1, int(r.dim))
                    norms = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
                    sim = np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)
                    m = min(k, sim.shape[1])
                    i, j = np.nonzero(sim >= -np.partition(-sim, m - 1, axis=1)[:, m - 1:m] - 1e-12)
                    qids, ids = np.array([x["qid"] for x in r.questions], object), np.asarray(r.ids, object)
                    yield pd.DataFrame({"tenant_id": r.tenant_id, "qid": qids[i], "span_id": ids[j], "score": sim[i, j]})

        blocks = self.log.read(asked).select("tenant_id", "block", "dim", "ids", "data")
        return blocks.join(asked, ["tenant_id", "block"]).select("tenant_id", "dim", "ids", "data", "questions").mapInPandas(
            run, "tenant_id string, qid string, span_id string, score double")

    def search(self, questions: DataFrame, k: int, probe: int = PROBE) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(hits, first, second): per question at least its ``k`` best (tenant_id, qid, span_id, score), and the (question, block) pairs of both passes.

        ``questions``: tenant_id, qid, vector; null and zero vectors have no hits. Exact: a block is left out only if its bound is below the
        k-th best score that the question has already.
        """
        q = stored_table(questions.filter(F.col("vector").isNotNull() & ~vec.is_zero(F.col("vector"))).select("tenant_id", "qid", "vector"))
        groups = max(1, -(-q.count() // QUESTIONS))
        near = stored_table(self.bounds(q))
        best = Window.partitionBy("tenant_id", "qid").orderBy(F.desc("bound"), "block")
        first = stored_table(near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= probe).select("tenant_id", "qid", "block"))
        hits = stored_table(self._evaluated(first, q, k, groups))
        top = Window.partitionBy("tenant_id", "qid").orderBy(F.desc("score"), "span_id")
        kth = hits.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") == k).select("tenant_id", "qid", F.col("score").alias("kth"))
        second = stored_table(near.join(kth, ["tenant_id", "qid"], "left").filter(F.col("bound") >= F.coalesce("kth", F.lit(-2.0)) - _EPS)
                              .join(first, ["tenant_id", "qid", "block"], "left_anti").select("tenant_id", "qid", "block"))
        return hits.unionByName(self._evaluated(second, q, k, groups)), first, second
