"""Incremental compilation: change detection, manifests, upserts, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklore.functions import text as tx

# Batch switch, newest documents listed, kept length of an error text.
BATCH_THRESHOLD, DOCUMENT_LIST, ERROR_CHARS = 30, 50, 4000


def unit_hash(content, prompt_version: str, model: str) -> Column:
    return tx.content_hash(content, F.lit(prompt_version), F.lit(model))


def changed(new: DataFrame, manifest: DataFrame) -> DataFrame:
    """New chunks labelled new / changed / unchanged against the last manifest."""
    prev = manifest.select("tenant_id", "chunk_id", F.col("content_hash").alias("prev_hash")).distinct()
    return new.join(prev, ["tenant_id", "chunk_id"], "left").withColumn(
        "change", F.when(F.col("prev_hash").isNull(), "new")
        .when(F.col("prev_hash") != F.col("content_hash"), "changed").otherwise("unchanged"))


def to_compile(new: DataFrame, manifest: DataFrame) -> DataFrame:
    return changed(new, manifest).filter("change <> 'unchanged'")


def manifest_links(manifest: DataFrame) -> DataFrame:
    """Long form (chunk, kind, artifact): arrays of ids would grow with hot chunks."""
    return manifest.select("tenant_id", "chunk_id", "content_hash", F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.col(c).alias("artifact_id")) for kind, c in
        [("fact", "fact_id"), ("entity", "entity_id"), ("wiki", "wiki_node_id")]])).alias("a")).select(
        "tenant_id", "chunk_id", "content_hash", "a.*").filter("artifact_id is not null")


def stale_artifacts(new: DataFrame, links: DataFrame) -> DataFrame:
    """Artifacts of chunks whose hash changed."""
    now = new.select("tenant_id", "chunk_id", F.col("content_hash").alias("new_hash"))
    return (links.join(now, ["tenant_id", "chunk_id"]).filter("content_hash <> new_hash")
            .select("tenant_id", "chunk_id", "kind", "artifact_id"))


def record_manifest(chunks: DataFrame, produced: DataFrame) -> DataFrame:
    """Links of the produced artifacts with the current hash of their chunk."""
    return produced.select("tenant_id", "chunk_id", "kind", "artifact_id").distinct().join(
        chunks.select("tenant_id", "chunk_id", "content_hash"), ["tenant_id", "chunk_id"])


def existing_hashes(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    return chunks.join(documents.select("tenant_id", "document_id"), ["tenant_id", "document_id"],
                       "left_semi").select("tenant_id", "document_id", "chunk_id", "content_hash")


def upsert_documents(base: DataFrame, arrivals: DataFrame, now: float) -> DataFrame:
    """Insert, or replace title, uri, depth and pages; the status of a known document stays."""
    fields = ["title", "source_uri", "depth", "page_count"]
    old = base.select("tenant_id", "document_id", F.struct(*fields, "status", "updated_at").alias("o"))
    new = arrivals.select("tenant_id", "document_id", F.struct(*fields, "status").alias("n"))
    return old.join(new, ["tenant_id", "document_id"], "full").select(
        "tenant_id", "document_id", *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in fields],
        F.coalesce("o.status", "n.status").alias("status"),
        F.when(F.col("n").isNotNull(), float(now)).otherwise(F.col("o.updated_at")).alias("updated_at"))


def latest_wins(base: DataFrame, arrivals: DataFrame, key: list[str], values: list[str], seq: str = "seq") -> DataFrame:
    """Keyed replacement: the row with the largest ``seq`` of each key, by partial aggregation."""
    both = base.select(*key, *values, seq).unionByName(arrivals.select(*key, *values, seq))
    return both.groupBy(*key).agg(F.max_by(F.struct(*values), seq).alias("v")).select(*key, "v.*")


def fold_status(events: DataFrame) -> DataFrame:
    """Latest status event of each document, the error text cut."""
    return events.groupBy("tenant_id", "document_id").agg(
        F.max_by(F.struct("status", "error", "ts"), F.struct("ts", "seq")).alias("e")).select(
        "tenant_id", "document_id", "e.status", F.substring("e.error", 1, ERROR_CHARS).alias("compile_error"),
        F.col("e.ts").alias("updated_at"))


def level_done(done: DataFrame, expected: DataFrame) -> DataFrame:
    n = done.groupBy("job_id", "level").agg(F.count(F.lit(1)).alias("done"))
    return expected.join(n, ["job_id", "level"], "left").withColumn(
        "done", F.coalesce("done", F.lit(0))).withColumn(
        "complete", (F.col("expected") > 0) & (F.col("done") >= F.col("expected")))


def batch_documents(units: DataFrame, threshold: int = BATCH_THRESHOLD) -> DataFrame:
    """Changed units of documents that have at least ``threshold`` of them."""
    big = units.groupBy("tenant_id", "document_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= threshold)
    return units.join(big, ["tenant_id", "document_id"])


def compile_summary(documents: DataFrame, **parts: DataFrame) -> DataFrame:
    """Row counts of each part table per document."""
    out = documents.select("tenant_id", "document_id")
    for name, df in parts.items():
        out = out.join(df.groupBy("tenant_id", "document_id").agg(F.count(F.lit(1)).alias(name)),
                       ["tenant_id", "document_id"], "left")
    return out.na.fill(0)


def newest_documents(documents: DataFrame, n: int = DOCUMENT_LIST) -> DataFrame:
    w = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), "document_id")
    return documents.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
