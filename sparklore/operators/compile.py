"""Documents to chunks and spans: the first compile level as one narrow job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklore.functions import text as tx


def redact_documents(docs: DataFrame, column: str = "content") -> DataFrame:
    clean, hits = tx.redact(column)
    return docs.withColumns({"hits": hits, column: clean})


def redaction_report(docs: DataFrame, by: str, column: str = "content") -> DataFrame:
    """Hits and affected documents by pattern and source; one partial aggregation."""
    cells = F.array(*[F.struct(F.lit(n).alias("pattern"), c.alias("hits"))
                      for n, c in tx.redaction_hits(column).items()])
    return (docs.select(by, F.explode(cells).alias("c")).select(by, "c.*").filter("hits > 0")
            .groupBy(by, "pattern").agg(F.sum("hits").alias("hits"), F.count(F.lit(1)).alias("documents")))


def split_sections(docs: DataFrame, column: str = "content") -> DataFrame:
    keep = [c for c in docs.columns if c != column]
    return docs.select(*keep, F.posexplode(tx.sections(column)).alias("sec_no", "s")).select(
        *keep, "sec_no", F.col("s.path").alias("section_path"), "s.body", F.col("s.ord").alias("sec_ord"))


def compile_chunks(docs: DataFrame, column: str = "content", target: int = tx.CHUNK_TARGET,
                   hard_max: int = tx.CHUNK_MAX, prompt_version: str = "v1",
                   summary_chars: int = 200) -> DataFrame:
    """Chunks of every document with ids, hashes, summaries and character offsets.

    A document is the unit of work: nothing is shuffled, and long documents only make
    their own row larger.
    """
    keep = [c for c in docs.columns if c != column]

    def chunks_of(secs):
        return F.flatten(F.transform(secs, lambda s: F.transform(
            tx.chunk_texts(s["body"], target, hard_max), lambda t, i: F.struct(
                s["path"].alias("section_path"), s["ord"].alias("sec_ord"), i.alias("chunk_ord"), t.alias("content")))))

    def placed(packed):
        offs = tx.locate_parts(column, F.transform(packed, lambda p: p["content"]), fallback_to_cursor=True)
        return F.zip_with(packed, offs, lambda p, o: F.struct(
            p["section_path"].alias("section_path"), p["sec_ord"].alias("sec_ord"), p["chunk_ord"].alias("chunk_ord"),
            p["content"].alias("content"), o.alias("start_offset")))

    every = tx.let(tx.sections(column), lambda secs: tx.let(chunks_of(secs), placed))
    rows = docs.select(*keep, F.posexplode(every).alias("chunk_no", "p")).select(*keep, "chunk_no", "p.*")
    return rows.withColumns({
        "chunk_id": tx.stable_id("ch", "document_id", "section_path", "sec_ord", "chunk_ord"),
        "content_hash": tx.content_hash("content", F.lit(prompt_version)),
        "summary": tx.summary("content", summary_chars),
        "end_offset": F.col("start_offset") + F.length("content")})


def compile_spans(chunks: DataFrame, target: int = tx.SPAN_TARGET) -> DataFrame:
    """Spans of every chunk with ids and the offset in the document."""
    # Offsets join their span before the explode: a column next to the explode would be
    # computed again for every span of the chunk.
    placed = tx.let(tx.span_texts("content", target), lambda sp: F.zip_with(
        sp, tx.locate_parts("content", F.transform(sp, lambda s: s["content"]), fallback_to_cursor=False),
        lambda s, o: F.struct(s["content"].alias("content"), s["span_type"].alias("span_type"), o.alias("rel"))))
    rows = chunks.select("tenant_id", "document_id", "chunk_id", "start_offset",
                         F.posexplode(placed).alias("span_no", "s"))
    return rows.select(
        "tenant_id", "document_id", "chunk_id", "span_no",
        tx.stable_id("sp", "chunk_id", "span_no", tx.content_hash("s.content")).alias("span_id"),
        "s.content", "s.span_type", (F.col("start_offset") + F.col("s.rel")).alias("offset"))


def assign_pages(points: DataFrame, page_map: DataFrame, offset: str = "offset") -> DataFrame:
    """As-of join: the page of the last page start at or before each offset, at least 1.

    Both sides are stacked and sorted once per document, so no pair of point and page start
    is ever formed.
    """
    key = ["tenant_id", "document_id"]
    cols = [c for c in points.columns if c not in key]
    starts = page_map.select(*key, F.col("start").alias("_at"), F.lit(0).alias("_is_point"),
                             F.col("page").alias("_page"), F.lit(None).alias("_row"))
    marks = points.select(*key, F.col(offset).cast("long").alias("_at"), F.lit(1).alias("_is_point"),
                          F.lit(None).cast("long").alias("_page"), F.struct(*cols).alias("_row"))
    w = Window.partitionBy(*key).orderBy("_at", "_is_point").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    stacked = starts.withColumn("_row", F.lit(None).cast(marks.schema["_row"].dataType)).unionByName(marks)
    return (stacked.withColumn("page", F.greatest(F.lit(1), F.coalesce(F.last("_page", True).over(w), F.lit(1))))
            .filter("_is_point = 1").select(*key, "_row.*", "page"))


def size_profile(docs: DataFrame, by: str, column: str = "content") -> DataFrame:
    t = tx.est_tokens(column).cast("long")
    return docs.select(by, t.alias("t")).groupBy(by).agg(
        F.count(F.lit(1)).alias("documents"), F.sum("t").alias("tokens"), F.max("t").alias("max_tokens"),
        F.percentile("t", 0.5).alias("median_tokens"))


def table_of_contents(chunks: DataFrame) -> DataFrame:
    return chunks.select("tenant_id", "document_id", "section_path").distinct()


def summaries(chunks: DataFrame, limit: Column) -> DataFrame:
    return chunks.withColumn("summary", tx.summary("content", limit))
