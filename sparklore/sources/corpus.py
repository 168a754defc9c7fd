"""Reading and writing corpora, tables, snapshots and histories."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklore.functions import text as tx
from sparklore.session import ensure_checkpoint_dir, settings

#: Files that one task writes at once.
OPEN_TENANTS = 16

#: For writers of very many small files: on a local disk each file is created once, without a checksum file beside it, because
#: Hadoop starts a process for the permissions of every file that it creates there. Other file systems are as they were.
SMALL_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

GOLDEN_SCHEMA = "id string, bucket string, question string, answer string, golden_span_ids array<string>"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder for one run of a sink."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def writers(spark: SparkSession) -> int:
    """Tasks that write one file per row. Stated, because the time follows the files: by their bytes so few tasks are left that a last one
    doubles the time."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def read_text_corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row per text or markdown file below ``root``: tenant_id (the first folder), document_id, content (whole text).

    The document id is the path below the tenant's folder without the ending, so files of equal name in two folders
    stay apart.
    """
    name = root.rstrip("/").rsplit("/", 1)[-1]
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    inner = F.substring_index(path, f"/{name}/", -1)
    # Folders are listed by as many tasks as there are writers, not by one task per folder.
    with settings(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(writers(spark))}):
        files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return (files.select(F.substring_index(inner, "/", 1).alias("tenant_id"),
                         F.regexp_extract(inner, r"^[^/]*/(.*?)(\.[^./]*)?$", 1).alias("document_id"),
                         F.col("value").alias("content")))


def plan_shards(documents: DataFrame, size: int = 40, overlap: int = 1) -> DataFrame:
    """Page ranges of ``size`` pages, each but the first reaching back ``overlap`` pages."""
    starts = documents.filter("page_count > 0").select(
        "tenant_id", "document_id", "page_count",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("page_count") - 1, F.lit(size).cast("long"))).alias("shard", "s"))
    return starts.select(
        "tenant_id", "document_id", F.col("shard").cast("long").alias("shard"),
        F.greatest(F.lit(0), F.col("s") - F.when(F.col("s") > 0, overlap).otherwise(0)).alias("page_start"),
        F.least(F.col("s") + size, F.col("page_count")).alias("page_end"))


def stitch(parts: DataFrame, order: str = "shard", column: str = "content") -> DataFrame:
    """One text per document from its parts; a document is the bound of the collected list."""
    return parts.groupBy("tenant_id", "document_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order, column))), lambda p: p[column]), "\n\n").alias("content"))


def pages_as_documents(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", tx.page_markdown("html").alias("content"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN_SCHEMA).json(path)


def write_by_tenant(df: DataFrame, path: str) -> None:
    """Parquet with one folder per tenant. Files are cut by size, not one writer per tenant.

    A task keeps the files of up to ``OPEN_TENANTS`` tenants open, and only with more of them sorts its rows by tenant.
    """
    with settings(df.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_TENANTS)}):
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("tenant_id").parquet(path)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_snapshot(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write every table below ``path`` and return its manifest (table, rows), counted from
    the written files."""
    manifest = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        row = df.sparkSession.read.parquet(f"{path}/{name}").agg(
            F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        manifest = row if manifest is None else manifest.unionByName(row)
    return manifest


def rebuild_list(documents: DataFrame) -> DataFrame:
    """Every document queued again for the first level under a rebuild hash."""
    return documents.select(
        "tenant_id", "document_id", F.lit("L1").alias("level"), F.col("document_id").alias("unit_id"),
        tx.content_hash("source_uri", F.lit("rebuild"), F.lit("v1")).alias("input_hash"), "depth",
        F.lit(0).alias("attempt"))
