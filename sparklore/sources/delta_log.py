"""A table as a hash-bucketed base and small deltas, merged when it is read.

Layout below one folder that all executors share: ``data/_version=v/_bucket=b/`` holds rows, ``commits/`` one row per
finished version. A version counts once its commit row stands, so a write that dies half way is never read, and a batch
id that is committed is not written twice. One writer at a time; any number of readers.

Rows with ``keys`` replace older rows of the same keys (``_deleted`` true removes them); without keys rows only add up.
What is written per batch follows the batch. ``compact`` folds the deltas of those buckets that have any into a new
base of these buckets; the files of other buckets stay as they are. A log of one bucket is written by the tasks that
have the rows, without a shuffle or a sort.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sparklore.session import TIDY, settings

COMMITS = "version long, kind string, batch_id long, buckets array<int>, emptied array<int>"


class DeltaLog:
    def __init__(self, spark: SparkSession, path: str, schema: str, bucket_by: list[str], keys: list[str] | None = None,
                 buckets: int = 32, sort_by: list[str] | None = None):
        """``schema``: DDL of the rows. ``bucket_by``: the columns whose hash chooses the bucket; rows of equal ``keys`` agree in them."""
        self.spark, self.path = spark, path.rstrip("/")
        self.bucket_by, self.keys, self.buckets, self.sort_by = bucket_by, keys, buckets, sort_by or []
        self.schema = schema if keys is None else f"{schema}, _deleted boolean"
        self.columns = spark.createDataFrame([], self.schema).columns

    def commits(self) -> list[Row]:
        """One row per version, oldest first: a few dozen bytes each, and few between two compactions."""
        try:
            found = self.spark.read.schema(COMMITS).parquet(f"{self.path}/commits").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(found, key=lambda r: r["version"])

    def exists(self) -> bool:
        return bool(self.commits())

    @staticmethod
    def _live(commits: list[Row]) -> dict[int, list[int]]:
        """The versions to read per bucket: the newest base and the deltas after it."""
        live: dict[int, list[int]] = {}
        for c in commits:
            for b in c["buckets"]:
                live[b] = [*(live.get(b, []) if c["kind"] == "delta" else []), c["version"]]
            for b in c["emptied"]:
                live[b] = []
        return live

    def bucket_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str, batch_id: int | None, commits: list[Row], replaced: list[int]) -> None:
        version = commits[-1]["version"] + 1 if commits else 0
        folder = f"{self.path}/data/_version={version}"
        dealt = rows.select(*self.columns, self.bucket_of().alias("_bucket"))
        if self.buckets > 1:
            # Split by size, not by bucket alone, so a hot bucket is written by several tasks.
            dealt = dealt.hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", *self.sort_by)
        with settings(dealt.sparkSession, TIDY):
            dealt.write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        written = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(folder).select("_bucket").distinct()
        there = sorted(r[0] for r in written.collect())
        row = (version, kind, batch_id, there, [b for b in replaced if b not in there])
        self.spark.createDataFrame([row], COMMITS).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def append(self, rows: DataFrame, batch_id: int | None = None) -> bool:
        """Adds the rows as one delta; False, and nothing written, if ``batch_id`` was committed before."""
        commits = self.commits()
        if batch_id is not None and any(c["batch_id"] == batch_id for c in commits):
            return False
        if "_deleted" in self.columns and "_deleted" not in rows.columns:
            rows = rows.withColumn("_deleted", F.lit(False))
        self._write(rows, "delta", batch_id, commits, [])
        return True

    def appended(self, batch_id: int | None = None) -> DataFrame:
        """The rows of one delta: that of ``batch_id``, or without one the newest that has none."""
        c = [c for c in self.commits() if c["kind"] == "delta" and c["batch_id"] == batch_id][-1]
        return self._rows({b: [c["version"]] for b in c["buckets"]}).select(*self.columns)

    def _rows(self, live: dict[int, list[int]]) -> DataFrame:
        """All rows of the given buckets and versions; other files are not even listed."""
        schema = f"{self.schema}, _version int, _bucket int"
        paths = [f"{self.path}/data/_version={v}/_bucket={b}" for b, versions in live.items() for v in versions]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def _merged(self, live: dict[int, list[int]]) -> DataFrame:
        if self.keys is None:
            return self._rows(live).select(*self.columns)
        out = [c for c in self.columns if c != "_deleted"]
        settled = self._rows({b: v for b, v in live.items() if len(v) == 1}).filter("NOT _deleted").select(*out)
        layered = {b: v for b, v in live.items() if len(v) > 1}
        if not layered:
            return settled
        rest = [c for c in self.columns if c not in self.keys]
        newest = self._rows(layered).groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "_version").alias("_row"))
        return settled.unionByName(newest.select(*self.keys, "_row.*").filter("NOT _deleted").select(*out))

    def read(self, touching: DataFrame | None = None) -> DataFrame:
        """The table as it is now; with ``touching`` (rows that have the ``bucket_by`` columns) only the buckets of those."""
        live = self._live(self.commits())
        if touching is not None:
            wanted = {r[0] for r in touching.select(self.bucket_of()).distinct().collect()}     # the number of buckets at most
            live = {b: v for b, v in live.items() if b in wanted}
        return self._merged(live)

    def compact(self) -> list[int]:
        """Folds deltas into a new base of the buckets that have any, and returns those buckets. Readers see the old state or the new one."""
        commits = self.commits()
        bases = {c["version"] for c in commits if c["kind"] == "base"}
        dirty = {b: v for b, v in self._live(commits).items() if set(v) - bases}
        if dirty:
            rows = self._merged(dirty)
            self._write(rows if self.keys is None else rows.withColumn("_deleted", F.lit(False)), "base", None, commits, sorted(dirty))
        return sorted(dirty)
