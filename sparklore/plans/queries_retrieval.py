"""Retrieval queries over the table of benchmark questions."""

from pyspark.sql import functions as F

from sparklore.functions import vectors as vec
from sparklore.operators import retrieval as ret
from sparklore.functions.scorers import pair_scorer
from sparklore.operators import wiki
from sparklore.plans.registry import query
from sparklore.session import stored_table

R = F.round
OUT = ["tenant_id", "qid", "span_id", "rank"]


def shown(df):
    return df.select(*OUT, R("score", 6).alias("score"))


def shown_sql(table):
    return f"SELECT tenant_id, qid, span_id, rank, round(score, 6) AS score FROM {table}"


@query("ret01_vector_top_k", shown_sql("kb_vector_stream"))
def _(kb):
    return shown(ret.vector_stream(kb.question_vectors, kb.spans_with_vectors))


@query("ret01_vector_search_by_blocks", shown_sql("kb_vector_stream"))
def _(kb):
    return shown(ret.vector_search(kb.question_vectors, kb.vector_index))


@query("ret01_vector_top_k_by_label", """
SELECT * FROM (SELECT v.label, e.vec_id, round(list_cosine_similarity(v.vector, CAST(e.embedding AS DOUBLE[])), 6) AS sim,
  row_number() OVER (PARTITION BY v.label ORDER BY round(list_cosine_similarity(v.vector, CAST(e.embedding AS DOUBLE[])), 9) DESC,
                     CAST(e.vec_id AS VARCHAR)) AS rank FROM kb_query_vectors v, embeddings e) WHERE rank <= 50""")
def _(kb):
    q = kb.query_vectors.select(F.lit("all").alias("tenant_id"), F.col("label").cast("string").alias("qid"), "vector")
    s = kb.raw("embeddings").select(F.lit("all").alias("tenant_id"), F.col("vec_id").cast("string").alias("span_id"), "embedding")
    return ret.vector_stream(q, s).select(F.col("qid").cast("long").alias("label"), F.col("span_id").cast("long").alias("vec_id"),
                                          R("score", 6).alias("sim"), "rank")


@query("ret02_postings", "SELECT tenant_id, span_id, term, doc_len, tf FROM kb_postings")
def _(kb):
    return ret.postings(kb.spans)


@query("ret02_term_statistics", """
SELECT tenant_id, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM kb_postings GROUP BY 1, 2""")
def _(kb):
    return ret.term_statistics(kb.spans)


@query("ret03_text_top_k", shown_sql("kb_text_stream"))
def _(kb):
    return shown(ret.text_stream(kb.questions, kb.search_index))


@query("ret04_trigram_top_k", shown_sql("kb_trigram_stream"))
def _(kb):
    return shown(ret.trigram_stream(kb.questions, kb.search_index))


def graph_rows(kb):
    return ret.graph_stream(kb.question_vectors, kb.spans, kb.entities, kb.edges, kb.edge_spans)


@query("ret05_graph_stream", shown_sql("kb_graph_stream"))
def _(kb):
    return shown(graph_rows(kb))


def fused(kb):
    return ret.fuse([ret.vector_stream(kb.question_vectors, kb.spans_with_vectors), ret.text_stream(kb.questions, kb.search_index),
                     ret.trigram_stream(kb.questions, kb.search_index), graph_rows(kb)])


@query("ret06_rank_fusion", shown_sql("kb_fused"))
def _(kb):
    return shown(fused(kb))


def pair_scores(kb, rows):
    return rows.select("tenant_id", "qid", "span_id").join(kb.model_scores, ["tenant_id", "span_id"])


@query("ret07_rerank", shown_sql("kb_reranked"))
def _(kb):
    f = stored_table(fused(kb))     # read twice: by the scores and by the ranking
    return shown(ret.rerank(f, pair_scores(kb, f), 16))


@query("ret07_rerank_equal", """
SELECT tenant_id, qid, span_id, rank, round(1.0 / n, 6) AS score FROM (
  SELECT *, count(*) OVER (PARTITION BY tenant_id, qid) AS n FROM kb_vector_stream) WHERE rank <= 8""")
def _(kb):
    return shown(ret.rerank(ret.vector_stream(kb.question_vectors, kb.spans_with_vectors)))


@query("ret08_tier_weights", shown_sql("kb_results"))
def _(kb):
    f = stored_table(fused(kb))
    return shown(ret.weigh_by_tier(ret.rerank(f, pair_scores(kb, f), 16), kb.spans, kb.chunks))


@query("ret09_catalogue", """
SELECT tenant_id, string_agg('- [' || section_path || '] ' || summary, chr(10) ORDER BY rn) AS catalogue FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY
    CASE tier WHEN 'core' THEN 1.0 WHEN 'supporting' THEN 0.7 WHEN 'peripheral' THEN 0.3 ELSE 0.7 END DESC, chunk_id) AS rn
  FROM kb_chunks WHERE summary <> '') WHERE rn <= 80 GROUP BY 1""")
def _(kb):
    return ret.catalogue(kb.chunks)


@query("ret10_decide_tier", """
SELECT tenant_id, qid, length(question) % 2 = 0 AND bucket <> 'table' AS answerable,
       CASE WHEN (length(question) % 2 = 0 AND bucket <> 'table') OR bucket = 'summary' THEN 0 ELSE 1 END AS tier FROM kb_questions""")
def _(kb):
    q = kb.questions.withColumn("index_only", F.col("bucket") == "summary")
    verdicts = kb.questions.filter("bucket <> 'table'").select(
        "tenant_id", "qid", (F.length("question") % 2 == 0).alias("answerable"), F.lit("yes").alias("answer"))
    return ret.decide_tier(q, verdicts).select("tenant_id", "qid", "answerable", "tier")


@query("ret11_scope_filter", """
WITH sc AS (SELECT tenant_id, document_id FROM kb_documents WHERE depth = 'D1'),
v AS (SELECT q.tenant_id, q.qid, s.span_id, list_cosine_similarity(q.vector, s.embedding) AS score
      FROM kb_question_vectors q JOIN kb_span_vectors s USING (tenant_id) SEMI JOIN sc USING (tenant_id, document_id))
SELECT tenant_id, qid, span_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, span_id) AS rank FROM v) WHERE rank <= 50""")
def _(kb):
    scope = kb.documents.filter("depth = 'D1'")
    return shown(ret.vector_stream(kb.question_vectors, ret.in_scope(kb.spans_with_vectors, scope, ["text", "table_row"])))


def cited(kb):
    c = F.col("conv_id").cast("string")
    missing = (F.col("conv_id") + F.col("turn")) % 7 == 0
    return kb.answers.select(
        "tenant_id", F.concat(F.lit("doc_"), c).alias("document_id"),
        F.concat(F.lit("sp_"), c, F.when(missing, "_99999").otherwise("_1")).alias("span_id")).distinct()


CITED = """c AS (SELECT DISTINCT tenant_id, 'doc_' || conv_id AS document_id,
  'sp_' || conv_id || CASE WHEN (conv_id + turn) % 7 = 0 THEN '_99999' ELSE '_1' END AS span_id FROM kb_answers)"""


@query("ret12_read_span", "WITH " + CITED + """
SELECT tenant_id, document_id, span_id, content, page, section_path FROM c JOIN kb_spans s USING (tenant_id, document_id, span_id)
JOIN (SELECT tenant_id, chunk_id, section_path FROM kb_chunks) USING (tenant_id, chunk_id)""")
def _(kb):
    return ret.read_spans(cited(kb), kb.spans, kb.chunks).select(
        "tenant_id", "document_id", "span_id", "content", "page", "section_path")


@query("ret12_missing_spans", "WITH " + CITED + """
SELECT tenant_id, document_id, span_id FROM c ANTI JOIN kb_spans USING (tenant_id, document_id, span_id)""")
def _(kb):
    return ret.missing_spans(cited(kb), kb.spans)


@query("ret13_expand", "WITH " + CITED + """
SELECT c.tenant_id, c.span_id, k.chunk_id, k.content AS chunk, k.section_path FROM c JOIN kb_spans s USING (tenant_id, span_id)
JOIN kb_chunks k ON k.tenant_id = s.tenant_id AND k.chunk_id = s.chunk_id""")
def _(kb):
    return ret.expand(cited(kb).select("tenant_id", "span_id"), kb.spans, kb.chunks).select(
        "tenant_id", "span_id", "chunk_id", "chunk", "section_path")


@query("ret14_evidence_pack", """
SELECT tenant_id, qid, string_agg('[' || document_id || ':' || span_id || '] ' || content, chr(10) || chr(10) ORDER BY rank) AS evidence
FROM kb_vector_stream JOIN kb_spans USING (tenant_id, span_id) WHERE rank <= 8 GROUP BY 1, 2""")
def _(kb):
    return ret.evidence_pack(ret.vector_stream(kb.question_vectors, kb.spans_with_vectors), kb.spans)


def hybrid(kb):
    return ret.hybrid_search(kb.question_vectors, kb.spans_with_vectors, kb.chunks, kb.entities, kb.edges, kb.edge_spans, kb.search_index)


@query("ret15_hybrid_search", """
WITH eq AS (SELECT f.tenant_id, f.qid, f.span_id, f.rank AS before, c.tier,
              1.0 / count(*) OVER (PARTITION BY f.tenant_id, f.qid) AS e
            FROM kb_fused f JOIN kb_spans s USING (tenant_id, span_id) JOIN kb_chunks c USING (tenant_id, chunk_id)),
w AS (SELECT *, e * CASE tier WHEN 'core' THEN 1.0 WHEN 'supporting' THEN 0.7 WHEN 'peripheral' THEN 0.3 ELSE 0.7 END AS score
      FROM eq WHERE before <= 16)
SELECT tenant_id, qid, span_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, before) AS rank FROM w) WHERE rank <= 8""")
def _(kb):
    return shown(hybrid(kb))


NEAR = """
WITH near AS (SELECT l.tenant_id, l.qid, unnest([e.source_entity, e.target_entity]) AS entity_id FROM kb_linked l
              JOIN kb_edges e ON e.tenant_id = l.tenant_id AND l.entity_id IN (e.source_entity, e.target_entity)
              UNION SELECT tenant_id, qid, entity_id FROM kb_linked)
"""


def scope(kb):
    pages = kb.degrees.select("tenant_id", "entity_id", F.concat(F.lit("wk_"), "entity_id").alias("node_id"), F.col("name").alias("title"),
                              wiki.importance(F.col("degree")).alias("tier")).filter("tier <> 'peripheral'")
    return ret.navigation_scope(kb.question_vectors, kb.entities, kb.edges, pages)


@query("grf12_navigation_scope", NEAR + """
SELECT DISTINCT n.tenant_id, n.qid, e.document_id FROM near n JOIN kb_entities e USING (tenant_id, entity_id)""")
def _(kb):
    return scope(kb)[0]


@query("grf12_wiki_hints", NEAR + """
SELECT tenant_id, qid, rank, 'wk_' || entity_id AS node_id, title, tier FROM (
  SELECT n.tenant_id, n.qid, d.entity_id, d.name AS title, CASE WHEN degree >= 5 THEN 'core' ELSE 'supporting' END AS tier,
         row_number() OVER (PARTITION BY n.tenant_id, n.qid ORDER BY d.entity_id) AS rank
  FROM (SELECT DISTINCT tenant_id, qid, entity_id FROM near) n JOIN kb_degrees d USING (tenant_id, entity_id) WHERE degree >= 1) WHERE rank <= 10""")
def _(kb):
    return scope(kb)[1]


def word_overlap():
    """The share of a question's words that a text has: a scorer without a model file, loaded like one."""
    import re

    def score(questions, texts):
        both = [(set(re.findall(r"[a-z0-9]+", q.lower())), set(re.findall(r"[a-z0-9]+", t.lower()))) for q, t in zip(questions, texts)]
        return [len(a & b) / len(a) if a else 0.0 for a, b in both]
    return score


@query("ret07_rerank_by_scorer", """
WITH w AS (SELECT v.tenant_id, v.qid, v.span_id, v.rank AS before, list_distinct(regexp_extract_all(lower(q.question), '[a-z0-9]+')) AS a,
                  list_distinct(regexp_extract_all(lower(s.content), '[a-z0-9]+')) AS b
           FROM kb_vector_stream v JOIN kb_questions q USING (tenant_id, qid) JOIN kb_spans s USING (tenant_id, span_id)),
x AS (SELECT *, CASE WHEN len(a) > 0 THEN len(list_intersect(a, b)) / len(a) ELSE 0.0 END AS score FROM w)
SELECT tenant_id, qid, span_id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, before) AS rank FROM x) WHERE rank <= 8""")
def _(kb):
    found = stored_table(ret.vector_stream(kb.question_vectors, kb.spans_with_vectors))
    return shown(ret.rerank(found, ret.score_pairs(found, kb.questions, kb.spans, pair_scorer(word_overlap))))


@query("ext10_align_vectors", """
SELECT vec_id, 100 AS dims, round(list_sum(list_transform(v[1:32], lambda x: x * x)), 5) AS head, round(list_sum(list_transform(v, lambda x: x * x)), 5) AS whole
FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)""")
def _(kb):
    v = kb.raw("embeddings").select("vec_id", vec.align(F.col("embedding"), 100).alias("long"), vec.align(F.col("embedding"), 32).alias("short"))
    return v.select("vec_id", F.size("long").alias("dims"), R(vec.dot(F.col("short"), F.col("short")), 5).alias("head"),
                    R(vec.dot(F.col("long"), F.col("long")), 5).alias("whole"))
