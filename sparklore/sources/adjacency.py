"""The relation table as stored adjacency: both directions of every edge, clustered by node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklore.session import stored_table
from sparklore.sources.delta_log import DeltaLog

ROWS = ("tenant_id string, node string, other string, outgoing boolean, relation_id string, relation_type string, "
        "source_count long, confidence double")
EDGE = ["relation_id", "tenant_id", "source_entity", "relation_type", "target_entity", "source_count", "confidence"]
#: A frontier is sent to every task up to this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


class Adjacency:
    """Below ``path``, bucketed and sorted by (tenant, node): a hop opens the buckets of its frontier and does not move the edges."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.log = DeltaLog(spark, path, ROWS, ["tenant_id", "node"], ["tenant_id", "node", "relation_id", "outgoing"], buckets,
                            ["tenant_id", "node"])

    def extend(self, edges: DataFrame, batch_id: int | None = None) -> None:
        """Adds or replaces edges (``EDGE``); a self loop stands once."""
        def side(node: str, other: str, outgoing: bool) -> DataFrame:
            return edges.select("tenant_id", F.col(node).alias("node"), F.col(other).alias("other"), F.lit(outgoing).alias("outgoing"),
                                "relation_id", "relation_type", "source_count", "confidence")
        back = side("target_entity", "source_entity", False).filter("node <> other")
        self.log.append(side("source_entity", "target_entity", True).unionByName(back), batch_id)

    def touching(self, frontier: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
        """Rows of the frontier's nodes (tenant_id, entity_id and other key columns; stored), with those columns."""
        at = frontier.withColumnRenamed("entity_id", "node")
        size = at.agg(F.sum(sum(F.octet_length(F.col(c).cast("string")) + 8 for c in at.columns))).first()[0] or 0
        return self.log.read(at).join(F.broadcast(at) if size <= broadcast_bytes else at, ["tenant_id", "node"])

    def neighborhood(self, seeds: DataFrame, hops: int = 1) -> tuple[DataFrame, DataFrame]:
        """As ``graph.neighborhood``: (nodes with their hop, distinct edges) around seed rows (tenant_id, entity_id [, key columns])."""
        keys = seeds.columns
        extra = [k for k in keys if k not in ("tenant_id", "entity_id")]
        frontier = stored_table(seeds.distinct())
        visited, found = frontier.withColumn("hop", F.lit(0)), []
        for hop in range(1, max(1, hops) + 1):
            touched = self.touching(frontier)
            found.append(touched.select(
                "relation_id", "tenant_id", F.when(F.col("outgoing"), F.col("node")).otherwise(F.col("other")).alias("source_entity"),
                "relation_type", F.when(F.col("outgoing"), F.col("other")).otherwise(F.col("node")).alias("target_entity"),
                "source_count", "confidence", *extra))
            reached = touched.select("tenant_id", *extra, F.col("other").alias("entity_id")).distinct()
            frontier = stored_table(reached.join(visited.select(*keys), keys, "left_anti").select(*keys))
            visited = visited.unionByName(frontier.withColumn("hop", F.lit(hop)))
        return visited, reduce(DataFrame.unionByName, found).distinct()
