"""Hybrid retrieval over a whole table of questions: vector, full text, trigram and graph
candidates, rank fusion, rerank, tier weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklore.functions import text as tx
from sparklore.functions import vectors as vec
from sparklore.functions.trigrams import gram_matches, join_grams, pack_grams
from sparklore.operators import graph
from sparklore.operators.entities import link_entities
from sparklore.session import stored_table
from sparklore.sources.search_index import SearchIndex, counted_terms
from sparklore.sources.vector_index import VectorIndex

# Candidates per stream, results, fusion constant, trigram cut, BM25, tier weights.
CANDIDATES, FINAL, RRF_K = 50, 8, 60
TRIGRAM_MIN = 0.3
BM25_K1, BM25_B = 1.2, 0.75
TIER_WEIGHTS = {"core": 1.0, "supporting": 0.7, "peripheral": 0.3}
NO_TIER_WEIGHT = 0.7
CATALOGUE_ROWS, WIKI_HINTS = 80, 10


def ranked(rows: DataFrame, score: Column, k: int, keys=("tenant_id", "qid")) -> DataFrame:
    """The ``k`` best rows per question; every task keeps only its own ``k`` before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 9)), "span_id")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def sized_broadcast(questions: DataFrame, items: str, max_rows: int = 500_000):
    """A broadcast hint for tables made from the question table, if its items are few.

    The items (terms or trigrams) are counted first, on the question side only. With more of
    them no hint is given and Spark shuffles.
    """
    n = questions.agg(F.sum(F.size(items).cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast if n <= max_rows else (lambda df: df)


def in_scope(spans: DataFrame, documents: DataFrame | None = None, span_types: list[str] | None = None) -> DataFrame:
    """Spans of the given documents and types; both filters sit below every ranking."""
    out = spans
    if span_types:
        out = out.filter(F.col("span_type").isin(span_types))
    if documents is not None:
        out = out.join(documents.select("tenant_id", "document_id"), ["tenant_id", "document_id"], "left_semi")
    return out


def vector_stream(questions: DataFrame, spans: DataFrame, k: int = CANDIDATES, salts: int = 16) -> DataFrame:
    """Exact nearest spans by cosine for all questions, as products of packed blocks.

    While the packed questions are small (``join_blocks``) they go to the spans, which stay where they are.
    """
    q = vec.pack_blocks(questions.filter(~vec.is_zero(F.col("vector"))), ["tenant_id"], "qid", "vector", rows=256)
    s = vec.pack_blocks(spans.filter("embedding is not null"), ["tenant_id"], "span_id", "embedding")
    hits = vec.block_matches(vec.join_blocks(q, s, ["tenant_id"], salts), ["tenant_id"], top_k=k)
    rows = hits.select("tenant_id", F.col("a_id").alias("qid"), F.col("b_id").alias("span_id"), F.col("sim").alias("score"))
    return ranked(rows, F.col("score"), k)


def vector_search(questions: DataFrame, index: VectorIndex, k: int = CANDIDATES) -> DataFrame:
    """The exact nearest spans like ``vector_stream``, from stored blocks: blocks that cannot hold one of the ``k`` best are not opened."""
    hits, _, _ = index.search(questions, k)
    return ranked(hits, F.col("score"), k)


def postings(spans: DataFrame) -> DataFrame:
    """(tenant, span, term, tf, doc_len); counted inside the row, so nothing is shuffled."""
    return counted_terms(spans.select("tenant_id", "span_id", F.array_sort(tx.simple_tokens("content")).alias("tokens")))


def term_statistics(spans: DataFrame) -> DataFrame:
    return postings(spans).groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def text_stream(questions: DataFrame, index: SearchIndex, k: int = CANDIDATES) -> DataFrame:
    """BM25 over spans that hold all terms of the question, from the stored words of the spans alone.

    Each question drives the search with its rarest term: the spans that hold it are its candidates, and their other words
    decide at once, in the same row. Only matches leave a task. If the questions are too many to go to every task,
    candidates are found by shuffled terms and bring their words afterwards.
    """
    q = questions.select("tenant_id", "qid", F.array_distinct(tx.simple_tokens("question")).alias("terms")).filter(
        F.size("terms") > 0)
    asked = q.select("tenant_id", F.explode("terms").alias("term")).distinct()
    df = index.counts(asked, "term").select("tenant_id", "term", F.col("n").alias("df"))
    known = (q.select("tenant_id", "qid", F.size("terms").alias("n"), F.explode("terms").alias("term"))
             .join(df, ["tenant_id", "term"])
             .groupBy("tenant_id", "qid", "n").agg(  # bounded by the length of one question
                 F.array_sort(F.collect_list(F.struct("df", "term"))).alias("terms"))
             .filter("n = size(terms)").join(index.sizes(q), "tenant_id"))
    wanted = stored_table(known.select("tenant_id", "qid", "terms", "n_spans", "avg_len", F.get("terms", F.lit(0))["term"].alias("term")))
    small = sized_broadcast(wanted, "terms")
    spans = index.spans.read()
    each = spans.withColumn("term", F.explode(F.array_distinct("tokens")))
    lead = wanted.select("tenant_id", "term").distinct()
    if small is F.broadcast:
        found = each.join(F.broadcast(wanted), ["tenant_id", "term"])
    else:
        held = each.select("tenant_id", "term", "span_id").join(lead, ["tenant_id", "term"], "left_semi")
        found = held.join(wanted, ["tenant_id", "term"]).join(spans, ["tenant_id", "span_id"])
    length = F.lit(BM25_K1) * (1 - BM25_B + BM25_B * F.size("tokens") / F.col("avg_len"))

    def part(t: Column) -> Column:
        tf = F.size(F.filter("tokens", lambda x: x == t["term"]))
        idf = F.log(1 + (F.col("n_spans") - t["df"] + 0.5) / (t["df"] + 0.5))
        return idf * tf * (BM25_K1 + 1) / (tf + length)

    whole = F.size(F.array_except(F.transform("terms", lambda t: t["term"]), "tokens")) == 0
    score = F.aggregate("terms", F.lit(0.0), lambda total, t: total + part(t))
    return ranked(found.filter(whole).select("tenant_id", "qid", "span_id", score.alias("score")), F.col("score"), k)


def trigram_stream(questions: DataFrame, index: SearchIndex, k: int = CANDIDATES,
                   min_similarity: float = TRIGRAM_MIN) -> DataFrame:
    """Jaccard similarity of trigram sets, at least ``min_similarity``, from the stored words of the spans.

    Spans become blocks of posting lists of their trigrams where they lie, meet the blocks of questions of their tenant,
    and shared trigrams are counted inside the pair of blocks; only matches leave the task.
    """
    q = pack_grams(questions.select("tenant_id", "qid", tx.simple_tokens("question").alias("tokens")), "qid", "tokens", 512)
    s = pack_grams(index.spans.read(), "span_id", "tokens")
    hits = gram_matches(join_grams(q, s), min_similarity)
    return ranked(hits.select("tenant_id", F.col("a_id").alias("qid"), F.col("b_id").alias("span_id"), F.col("sim").alias("score")),
                  F.col("score"), k)


def graph_stream(questions: DataFrame, spans: DataFrame, entities: DataFrame, edges: DataFrame,
                 edge_spans: DataFrame, k: int = CANDIDATES, top_entities: int = 5) -> DataFrame:
    """Spans behind the edges around the linked entities, by edge confidence.

    A span's score for a question is its best score for one of the question's entities, so the ``k`` best spans of each
    entity hold the ``k`` best of every question. They are found once per asked entity, however many questions ask for a hub.
    """
    seeds = stored_table(link_entities(questions, entities, top_entities).select("tenant_id", "entity_id", "qid").distinct())
    asked = seeds.select("tenant_id", "entity_id").distinct()
    ends = edges.select("tenant_id", "relation_id", "confidence", F.explode(F.array_distinct(
        F.array("source_entity", "target_entity"))).alias("entity_id"))
    cited = ends.join(asked, ["tenant_id", "entity_id"], "left_semi").join(
        edge_spans.select("tenant_id", "relation_id", "span_id"), ["tenant_id", "relation_id"])
    best = cited.groupBy("tenant_id", "entity_id", "span_id").agg(F.max("confidence").alias("score"))
    real = best.join(spans.select("tenant_id", "span_id"), ["tenant_id", "span_id"], "left_semi")
    of_entity = ranked(real, F.col("score"), k, ("tenant_id", "entity_id")).drop("rank")
    rows = seeds.join(of_entity, ["tenant_id", "entity_id"]).groupBy("tenant_id", "qid", "span_id").agg(
        F.max("score").alias("score"))
    return ranked(rows, F.col("score"), k)


def navigation_scope(questions: DataFrame, entities: DataFrame, edges: DataFrame, pages: DataFrame, hops: int = 1,
                     hints: int = WIKI_HINTS) -> tuple[DataFrame, DataFrame]:
    """Where the answer to each question may stand: (documents, wiki hints).

    Documents (tenant_id, qid, document_id) are those of the linked entities and of all entities within ``hops`` edges. Hints (tenant_id,
    qid, rank, node_id, title, tier) are the first pages of these entities, at most ``hints`` of each question.
    """
    seeds = link_entities(questions, entities).select("tenant_id", "entity_id", "qid")
    nodes, _ = graph.neighborhood(edges, seeds, hops=hops)
    near = nodes.select("tenant_id", "qid", "entity_id").distinct()
    documents = near.join(entities.select("tenant_id", "entity_id", "document_id"), ["tenant_id", "entity_id"]).select(
        "tenant_id", "qid", "document_id").distinct()
    w = Window.partitionBy("tenant_id", "qid").orderBy("entity_id", "node_id")
    shown = (near.join(pages.select("tenant_id", "entity_id", "node_id", "title", "tier"), ["tenant_id", "entity_id"])
             .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= hints))
    return documents, shown.select("tenant_id", "qid", "rank", "node_id", "title", "tier")


def fuse(streams: list[DataFrame], k: int = RRF_K, keep: int = CANDIDATES) -> DataFrame:
    """Reciprocal rank fusion; a question with one stream keeps that stream's order."""
    rows = reduce(DataFrame.unionByName, [s.select("tenant_id", "qid", "span_id", "rank") for s in streams])
    score = rows.groupBy("tenant_id", "qid", "span_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))
    return ranked(score, F.col("score"), keep)


def rerank(fused: DataFrame, scores: DataFrame | None = None, keep: int = FINAL) -> DataFrame:
    """Order by outside scores (tenant_id, qid, span_id, model_score); without them all
    candidates of a question score 1/n and keep their fused order."""
    n = F.count(F.lit(1)).over(Window.partitionBy("tenant_id", "qid"))  # at most the fused candidates
    out = fused.withColumnRenamed("rank", "fused_rank").withColumn("equal", 1.0 / n)
    if scores is not None:
        out = out.join(scores, ["tenant_id", "qid", "span_id"], "left").withColumn(
            "score", F.coalesce("model_score", "equal")).drop("model_score")
    else:
        out = out.withColumn("score", F.col("equal"))
    w = Window.partitionBy("tenant_id", "qid").orderBy(F.desc(F.round("score", 9)), "fused_rank")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).drop("equal")


def score_pairs(candidates: DataFrame, questions: DataFrame, spans: DataFrame, scorer) -> DataFrame:
    """tenant_id, qid, span_id, model_score of candidate rows, by a scorer of two texts (``functions.scorers``). Only candidates bring their texts."""
    texts = (candidates.select("tenant_id", "qid", "span_id").join(questions.select("tenant_id", "qid", "question"), ["tenant_id", "qid"])
             .join(spans.select("tenant_id", "span_id", "content"), ["tenant_id", "span_id"]))
    return texts.select("tenant_id", "qid", "span_id", scorer("question", "content").alias("model_score"))


def tier_weight(tier: Column) -> Column:
    w = F.lit(NO_TIER_WEIGHT)
    for name, value in TIER_WEIGHTS.items():
        w = F.when(tier == name, value).otherwise(w)
    return w


def weigh_by_tier(results: DataFrame, spans: DataFrame, chunks: DataFrame, keep: int = FINAL) -> DataFrame:
    """Scores times the weight of the chunk's tier, then the best ``keep``."""
    tiers = results.join(spans.select("tenant_id", "span_id", "chunk_id"), ["tenant_id", "span_id"]).join(
        chunks.select("tenant_id", "chunk_id", "tier"), ["tenant_id", "chunk_id"], "left")
    weighed = tiers.withColumns({"score": F.col("score") * tier_weight(F.col("tier")), "before": F.col("rank")})
    w = Window.partitionBy("tenant_id", "qid").orderBy(F.desc(F.round("score", 9)), "before")
    return weighed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def catalogue(chunks: DataFrame, rows: int = CATALOGUE_ROWS) -> DataFrame:
    """One text per tenant: its first summaries by tier weight."""
    w = Window.partitionBy("tenant_id").orderBy(F.desc(tier_weight(F.col("tier"))), "chunk_id")
    top = chunks.filter("summary <> ''").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= rows)
    line = F.concat(F.lit("- ["), "section_path", F.lit("] "), "summary")
    return top.groupBy("tenant_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", line.alias("line")))), lambda r: r["line"]), "\n").alias("catalogue"))


def decide_tier(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Tier 0 if the summaries answer the question or the user wants only the index, else 1."""
    v = verdicts.select("tenant_id", "qid", "answerable", "answer")
    out = questions.join(v, ["tenant_id", "qid"], "left")
    answerable = F.coalesce("answerable", F.lit(False))
    only_index = F.coalesce("index_only", F.lit(False)) if "index_only" in questions.columns else F.lit(False)
    return out.withColumns({"answerable": answerable, "tier": F.when(answerable | only_index, 0).otherwise(1)})


def read_spans(requests: DataFrame, spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """Requested spans (tenant_id, document_id, span_id) with page and section; wrong owners miss."""
    sec = chunks.select("tenant_id", "chunk_id", "section_path")
    return (requests.join(spans, ["tenant_id", "document_id", "span_id"])
            .join(sec, ["tenant_id", "chunk_id"], "left"))


def missing_spans(requests: DataFrame, spans: DataFrame) -> DataFrame:
    return requests.join(spans, ["tenant_id", "document_id", "span_id"], "left_anti")


def expand(requests: DataFrame, spans: DataFrame, chunks: DataFrame) -> DataFrame:
    """The parent chunk of each requested span."""
    owner = spans.select("tenant_id", "span_id", "chunk_id")
    return requests.join(owner, ["tenant_id", "span_id"]).join(
        chunks.select("tenant_id", "chunk_id", F.col("content").alias("chunk"), "section_path"), ["tenant_id", "chunk_id"])


def evidence_pack(results: DataFrame, spans: DataFrame, keep: int = FINAL, sep: str = "\n\n") -> DataFrame:
    """``[document:span] text`` of the best spans, one text per question."""
    body = spans.select("tenant_id", "span_id", "document_id", "content")
    line = F.concat(F.lit("["), "document_id", F.lit(":"), "span_id", F.lit("] "), "content")
    rows = results.filter(F.col("rank") <= keep).join(body, ["tenant_id", "span_id"])
    return rows.groupBy("tenant_id", "qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("rank", line.alias("line")))), lambda r: r["line"]), sep).alias("evidence"))


def hybrid_search(questions: DataFrame, spans: DataFrame, chunks: DataFrame, entities: DataFrame,
                  edges: DataFrame, edge_spans: DataFrame, index: SearchIndex, scores: DataFrame | None = None,
                  keep: int = FINAL) -> DataFrame:
    """All four streams, fusion, rerank and tier weights for a table of questions in one job. ``index``: that of the spans."""
    streams = [vector_stream(questions, spans), text_stream(questions, index), trigram_stream(questions, index),
               graph_stream(questions, spans, entities, edges, edge_spans)]
    return weigh_by_tier(rerank(fuse(streams), scores, keep * 2), spans, chunks, keep)
