"""Sources, text preparation and incremental compilation queries."""

from pyspark.sql import functions as F

from sparklore.functions import text as tx
from sparklore.functions.markdown import markdown_blocks, register
from sparklore.functions.vectors import cosine, parse_vector
from sparklore.operators import compile as cp
from sparklore.operators import governance as gov
from sparklore.operators import incremental as inc
from sparklore.plans.fixtures import NOW
from sparklore.plans.registry import query
from sparklore.sources import corpus, graph_export as gx


def page_texts(kb):
    return corpus.pages_as_documents(kb.raw("pages"))


def as_documents(kb):
    return kb.documents.select("tenant_id", "document_id", "content")


@query("src01_read_corpus", "SELECT tenant_id, document_id, content || chr(10) AS content FROM kb_documents")
def _(kb):
    """All documents as one file each, in folders of tenants; rows are sorted by folder, so a task has one file open at a time."""
    root = corpus.run_folder(kb.spark, "corpus")
    (kb.documents.select(F.col("tenant_id").alias("tenant"), F.col("document_id").alias("doc"), "content")
     .repartition(corpus.writers(kb.spark), "tenant", "doc").sortWithinPartitions("tenant", "doc").write.options(**corpus.SMALL_FILES).partitionBy("tenant", "doc").text(root))
    return corpus.read_text_corpus(kb.spark, root).select(
        F.regexp_extract("tenant_id", "^tenant=(.*)$", 1).alias("tenant_id"),
        F.regexp_extract("document_id", "^doc=([^/]+)/", 1).alias("document_id"), "content")


@query("src01_documents", "SELECT tenant_id, document_id, content FROM kb_documents")
def _(kb):
    return kb.documents.select("tenant_id", "document_id", "content")


@query("src02_plan_shards", """
SELECT tenant_id, document_id, CAST(s // 4 AS BIGINT) AS shard, CAST(greatest(0, CASE WHEN s > 0 THEN s - 1 ELSE s END) AS BIGINT) AS page_start,
       CAST(least(s + 4, page_count) AS BIGINT) AS page_end
FROM (SELECT tenant_id, document_id, page_count, unnest(range(0, page_count, 4)) AS s FROM kb_documents)""")
def _(kb):
    return corpus.plan_shards(kb.documents, size=4, overlap=1)


@query("src03_stitch", """
SELECT document_id, string_agg(content, chr(10) || chr(10) ORDER BY span_no) AS content FROM kb_spans GROUP BY 1""")
def _(kb):
    return corpus.stitch(kb.spans, "span_no").select("document_id", "content")


@query("src04_page_markdown", "SELECT page_id, content FROM kb_page_text")
def _(kb):
    return page_texts(kb).select("page_id", "content")


@query("src05_golden_jsonl", """
SELECT q.qid AS id, bucket, question, count(g.span_id) AS n_gold FROM kb_questions q LEFT JOIN kb_gold g USING (qid)
GROUP BY 1, 2, 3""")
def _(kb):
    gold = kb.gold.groupBy("qid").agg(F.array_sort(F.collect_set("span_id")).alias("golden_span_ids"))
    rows = kb.questions.join(gold, "qid", "left").select(
        F.col("qid").alias("id"), "bucket", "question", F.lit("").alias("answer"),
        F.coalesce("golden_span_ids", F.array().cast("array<string>")).alias("golden_span_ids"))
    path = corpus.run_folder(kb.spark, "golden")
    rows.write.json(path)
    return corpus.read_golden(kb.spark, path).select(
        "id", "bucket", "question", F.size("golden_span_ids").cast("long").alias("n_gold"))


@query("src06_tenant_partitions", """
SELECT tenant_id, document_id, title, n_chars FROM kb_documents WHERE tenant_id = 't1'""")
def _(kb):
    path = corpus.run_folder(kb.spark, "documents")
    corpus.write_by_tenant(kb.documents, path)
    return kb.spark.read.parquet(path).filter("tenant_id = 't1'").select(
        "tenant_id", "document_id", "title", "n_chars")


@query("src07_snapshot", """
SELECT 'facts' AS table_name, count(*) AS n_rows FROM kb_facts UNION ALL SELECT 'entities', count(*) FROM kb_entities
UNION ALL SELECT 'relations', count(*) FROM kb_edges""")
def _(kb):
    return corpus.write_snapshot({"facts": kb.facts, "entities": kb.entities, "relations": kb.edges},
                                 corpus.run_folder(kb.spark, "snapshot"))


@query("src08_rebuild_list", """
SELECT tenant_id, document_id, 'L1' AS level, document_id AS unit_id,
       sha256(source_uri || chr(0) || 'rebuild' || chr(0) || 'v1' || chr(0)) AS input_hash, depth, 0 AS attempt
FROM kb_documents""")
def _(kb):
    return corpus.rebuild_list(kb.documents)


@query("src09_export_json", """
SELECT 'node' AS kind, entity_id AS id,
       '{"entity_id":"' || entity_id || '","name":"' || name || '","type":"' || type || '"}' AS line FROM kb_entities
UNION ALL SELECT 'edge', relation_id, '{"source":"' || source_entity || '","relation":"' || relation_type ||
       '","target":"' || target_entity || '"}' FROM kb_edges""")
def _(kb):
    return gx.json_lines(kb.entities, kb.edges)


@query("src10_export_graphml", """
SELECT 1 AS part, entity_id AS key, '<node id="' || entity_id || '"><data key="name">' || name ||
       '</data><data key="type">' || type || '</data></node>' AS line FROM kb_entities
UNION ALL
SELECT 2, lpad(CAST(n AS VARCHAR), 19, '0'), '<edge id="e' || n || '" source="' || source_entity || '" target="' ||
       target_entity || '"><data key="rel">' || relation_type || '</data></edge>'
FROM (SELECT *, row_number() OVER (ORDER BY left(sha256(relation_id), 3), relation_id) - 1 AS n FROM kb_edges)
UNION ALL SELECT * FROM (VALUES
 (0, '00', '<?xml version="1.0" encoding="UTF-8"?>'),
 (0, '01', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'),
 (0, '02', '<key id="name" for="node" attr.name="name" attr.type="string"/>'),
 (0, '03', '<key id="type" for="node" attr.name="type" attr.type="string"/>'),
 (0, '04', '<key id="rel" for="edge" attr.name="relation" attr.type="string"/>'),
 (0, '05', '<graph edgedefault="directed">'), (3, '00', '</graph>'), (3, '01', '</graphml>'))""")
def _(kb):
    return gx.graphml_lines(kb.entities, kb.edges)


@query("src11_export_cypher", """
SELECT 'node' AS kind, entity_id AS id, 'MERGE (e:Entity {id:''' || entity_id || '''}) SET e.name=''' || name ||
       ''', e.type=''' || type || ''';' AS line FROM kb_entities
UNION ALL SELECT 'edge', relation_id, 'MATCH (a:Entity {id:''' || source_entity || '''}),(b:Entity {id:''' ||
       target_entity || '''}) MERGE (a)-[:' || upper(relation_type) || ']->(b);' FROM kb_edges""")
def _(kb):
    return gx.cypher_lines(kb.entities, kb.edges)


@query("src12_artifact_history", """
SELECT tenant_id, seq, action, rank FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts DESC, seq DESC) AS rank
  FROM kb_audit) WHERE rank <= 50""")
def _(kb):
    path = corpus.run_folder(kb.spark, "history")
    rows = kb.audit.select("tenant_id", "seq", "action", "ts", "value")
    corpus.append_history(rows.filter("value < 5"), path)
    corpus.append_history(rows.filter("NOT value < 5 OR value IS NULL"), path)
    back = kb.spark.read.schema("tenant_id string, seq long, action string, ts double").json(path)
    return gov.newest_per_tenant(back, 50).select("tenant_id", "seq", "action", "rank")


@query("src13_parse_vector", """
SELECT vec_id, CASE WHEN label = 0 THEN NULL ELSE len(embedding) END AS dims,
       CAST(CASE WHEN label = 0 THEN 0 ELSE 1 END AS DOUBLE) AS sim FROM embeddings""")
def _(kb):
    raw = kb.raw("embeddings").withColumn("txt", F.concat(
        F.lit("["), F.array_join("embedding", ","), F.when(F.col("label") == 0, "").otherwise("]")))
    v = raw.withColumn("v", parse_vector(F.col("txt")))
    return v.select("vec_id", F.when(F.col("v").isNotNull(), F.size("v").cast("long")).alias("dims"),
                    F.round(cosine(F.col("v"), F.col("embedding")), 6).alias("sim"))


@query("txt01_redact", "SELECT doc_id, clean AS content, CAST(hits AS BIGINT) AS hits FROM kb_redacted")
def _(kb):
    return cp.redact_documents(kb.raw("documents").select("doc_id", F.col("text").alias("content"))).select(
        "doc_id", "content", F.col("hits").cast("long").alias("hits"))


_NAMES = [n for n, _, _ in tx.REDACTIONS]


@query("txt02_redaction_report", """
SELECT source, pattern, CAST(sum(h) AS BIGINT) AS hits, count(*) AS documents FROM (""" + " UNION ALL ".join(
    f"SELECT source, '{n}' AS pattern, h{i + 1} AS h FROM kb_redacted" for i, n in enumerate(_NAMES)) + """)
WHERE h > 0 GROUP BY 1, 2""")
def _(kb):
    return cp.redaction_report(kb.raw("documents"), "source", "text")


@query("txt03_sections", """
SELECT document_id, 0 AS sec_no, '' AS section_path, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS body FROM kb_documents
WHERE trim(content) <> ''""")
def _(kb):
    return cp.split_sections(as_documents(kb)).select("document_id", "sec_no", "section_path", "body")


@query("txt03_sections_of_pages")
def _(kb):
    return cp.split_sections(page_texts(kb)).select("page_id", "sec_no", "section_path", "body", "sec_ord")


@query("txt04_paragraphs", """
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS BIGINT) AS para_no, para
FROM (SELECT page_id, generate_subscripts(p, 1) AS i, unnest(p) AS para
      FROM (SELECT page_id, string_split_regex(content, '\\n\\s*\\n') AS p FROM kb_page_text))
WHERE trim(para, ' ' || chr(10) || chr(9)) <> ''""")
def _(kb):
    return page_texts(kb).select("page_id", F.posexplode(tx.paragraphs("content")).alias("n", "para")).select(
        "page_id", F.col("n").cast("long").alias("para_no"), "para")


@query("txt05_chunks", """
SELECT document_id, 0 AS chunk_no, '' AS section_path, regexp_replace(content, '^\\s+|\\s+$', '', 'g') AS content
FROM kb_documents WHERE trim(content) <> ''""")
def _(kb):
    return cp.compile_chunks(as_documents(kb)).select("document_id", "chunk_no", "section_path", "content")


@query("txt05_chunks_of_pages")
def _(kb):
    pages = page_texts(kb).select(F.lit("t0").alias("tenant_id"), tx.cat("page_", F.col("page_id")).alias("document_id"), "content")
    return cp.compile_chunks(pages, target=60, hard_max=100).select(
        "document_id", "chunk_no", "section_path", "chunk_ord", "content", "start_offset", "chunk_id", "summary")


def spans_of_documents(kb):
    return cp.compile_spans(cp.compile_chunks(as_documents(kb)))


@query("txt06_spans")
def _(kb):
    return spans_of_documents(kb)


@query("txt07_stable_ids", """
SELECT document_id, 'ch_' || left(sha256(document_id || chr(0) || '' || chr(0) || '0' || chr(0) || '0' || chr(0)), 16) AS chunk_id,
       sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g') || chr(0) || 'v1' || chr(0)) AS content_hash
FROM kb_documents WHERE trim(content) <> ''""")
def _(kb):
    return cp.compile_chunks(as_documents(kb)).select("document_id", "chunk_id", "content_hash")


def line_offsets(kb):
    """Character offset of each line, found by searching it in its document."""
    docs = as_documents(kb).withColumn("parts", F.split("content", "\n", -1))
    return docs.withColumn("offs", tx.locate_parts("content", F.col("parts"), True)).select(
        "tenant_id", "document_id", F.posexplode("offs").alias("line", "offset"))


LINES_SQL = """lines AS (SELECT tenant_id, document_id, span_no - 1 AS line, CAST(coalesce(sum(length(content) + 1) OVER (
  PARTITION BY document_id ORDER BY span_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM kb_spans)"""


@query("txt08_page_of_offset", "WITH " + LINES_SQL + """,
pm AS (SELECT document_id, unnest(range(0, n_chars, 1800)) AS start FROM kb_documents)
SELECT l.document_id, CAST(l.line AS BIGINT) AS line, CAST(l."offset" AS BIGINT) AS "offset", CAST(coalesce(p.start // 1800 + 1, 1) AS BIGINT) AS page
FROM lines l ASOF LEFT JOIN pm p ON p.document_id = l.document_id AND p.start <= l."offset\"""")
def _(kb):
    starts = kb.documents.filter("n_chars > 0").select("tenant_id", "document_id", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(1800).cast("long"))).alias("start"))
    pm = starts.withColumn("page", F.floor(F.col("start") / 1800) + 1)
    return cp.assign_pages(line_offsets(kb), pm).select(
        "document_id", F.col("line").cast("long").alias("line"), F.col("offset").cast("long").alias("offset"), "page")


@query("txt09_locate_lines", "WITH " + LINES_SQL + """
SELECT document_id, CAST(line AS BIGINT) AS line, "offset" FROM lines""")
def _(kb):
    return line_offsets(kb).select("document_id", F.col("line").cast("long").alias("line"),
                                   F.col("offset").cast("long").alias("offset"))


@query("txt10_summary", """
SELECT chunk_id, CASE WHEN length(s) > n THEN left(s, greatest(1, n - 3)) || '...' ELSE s END AS summary
FROM (SELECT chunk_id, coalesce(t.summary_max_chars, 200) AS n,
             replace(regexp_replace(content, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS s
      FROM kb_chunks LEFT JOIN kb_settings t USING (tenant_id))""")
def _(kb):
    rows = gov.effective_settings(kb.chunks.drop("summary"), kb.settings)
    return cp.summaries(rows, F.col("summary_max_chars")).select("chunk_id", "summary")


@query("txt11_size_profile", """
SELECT source, count(*) AS documents, CAST(sum(t) AS BIGINT) AS tokens, max(t) AS max_tokens, quantile_cont(t, 0.5) AS median_tokens
FROM (SELECT source, CAST(floor(length(text) / 2.5) AS BIGINT) AS t FROM documents) GROUP BY 1""")
def _(kb):
    return cp.size_profile(kb.raw("documents"), "source", "text")


BLOCKS_SQL = r"""
WITH l AS (SELECT page_id, generate_subscripts(string_split(content, chr(10)), 1) AS i, unnest(string_split(content, chr(10))) AS s FROM kb_page_text),
k AS (SELECT *, CASE WHEN regexp_matches(s, '^#{1,3}\s+.+') THEN 'h' WHEN s LIKE '> %' THEN 'quote' WHEN regexp_matches(s, '^\s*[-*]\s+') THEN 'ul'
                     WHEN regexp_matches(s, '^\s*\d+\.\s+') THEN 'ol' WHEN regexp_matches(s, '^\s*$') THEN 'blank' ELSE 'p' END AS kind FROM l),
f AS (SELECT *, CASE WHEN kind = 'h' OR kind IS DISTINCT FROM lag(kind) OVER w OR (kind = 'p' AND regexp_matches(s, '^(#|>|\s*[-*]\s|\s*\d+\.\s|```|\|)'))
                     THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY page_id ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY i) AS n FROM f),
b AS (SELECT page_id, n, kind AS type, CASE WHEN kind = 'h' THEN length(regexp_extract(min(s), '^(#{1,3})\s', 1)) ELSE 0 END AS level,
             CASE kind WHEN 'h' THEN regexp_extract(min(s), '^#{1,3}\s+(.+)', 1) WHEN 'p' THEN string_agg(s, ' ' ORDER BY i)
                  WHEN 'quote' THEN string_agg(s[3:], ' ' ORDER BY i)
                  ELSE '[' || string_agg('"' || replace(replace(regexp_extract(s, '^\s*(?:[-*]|\d+\.)\s+(.*)', 1), '\', '\\'), '"', '\"') || '"', ', ' ORDER BY i) || ']'
             END AS payload
      FROM g WHERE kind <> 'blank' GROUP BY page_id, n, kind)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INTEGER) AS block_no, type, CAST(level AS INTEGER) AS level, payload FROM b"""


@query("txt12_markdown_blocks", BLOCKS_SQL)
def _(kb):
    return markdown_blocks(page_texts(kb).select("page_id", "content"), "page_id", "content")


@query("txt12_markdown_blocks_in_sql", BLOCKS_SQL)
def _(kb):
    register(kb.spark)
    return kb.spark.sql("SELECT p.page_id, b.* FROM {pages} p, LATERAL markdown_blocks(p.content) b", pages=page_texts(kb))


@query("txt13_table_of_contents", "SELECT DISTINCT tenant_id, document_id, section_path FROM kb_chunks")
def _(kb):
    return cp.table_of_contents(kb.chunks)


@query("inc01_unit_hash", """
SELECT doc_id, sha256(clean || chr(0) || 'v1' || chr(0) || 'm1' || chr(0)) AS unit_hash FROM kb_redacted""")
def _(kb):
    clean, _ = tx.redact("text")
    return kb.raw("documents").select("doc_id", clean.alias("clean")).select(
        "doc_id", inc.unit_hash("clean", "v1", "m1").alias("unit_hash"))


@query("inc02_changed_chunks", """
SELECT c.tenant_id, c.chunk_id, CASE WHEN m.content_hash IS NULL THEN 'new'
  WHEN m.content_hash <> c.content_hash THEN 'changed' ELSE 'unchanged' END AS change
FROM kb_chunks c LEFT JOIN kb_manifest m USING (tenant_id, chunk_id)""")
def _(kb):
    return inc.changed(kb.chunks, kb.manifest).select("tenant_id", "chunk_id", "change")


@query("inc03_stale_artifacts", """
SELECT m.tenant_id, m.chunk_id, kind, artifact_id FROM kb_manifest m JOIN kb_chunks c USING (tenant_id, chunk_id),
LATERAL (SELECT 'fact' AS kind, m.fact_id AS artifact_id UNION ALL SELECT 'entity', m.entity_id UNION ALL SELECT 'wiki', m.wiki_node_id)
WHERE m.content_hash <> c.content_hash""")
def _(kb):
    return inc.stale_artifacts(kb.chunks, inc.manifest_links(kb.manifest))


@query("inc04_record_manifest", """
SELECT DISTINCT c.tenant_id, c.chunk_id, c.content_hash, 'entity' AS kind, f.subject_entity AS artifact_id
FROM kb_facts f JOIN kb_chunks c ON c.tenant_id = f.tenant_id AND c.document_id = f.document_id""")
def _(kb):
    made = kb.facts.select("tenant_id", F.regexp_replace("document_id", "^doc_", "ch_").alias("chunk_id"),
                           F.lit("entity").alias("kind"), F.col("subject_entity").alias("artifact_id"))
    return inc.record_manifest(kb.chunks, made).select("tenant_id", "chunk_id", "content_hash", "kind", "artifact_id")


@query("inc05_existing_hashes", """
SELECT tenant_id, document_id, chunk_id, content_hash FROM kb_chunks
WHERE document_id IN (SELECT document_id FROM kb_documents WHERE n_chars > 2000)""")
def _(kb):
    return inc.existing_hashes(kb.chunks, kb.documents.filter("n_chars > 2000"))


def old_and_new_documents(kb):
    """Labelled documents are known already; arrivals are the long ones."""
    old = kb.documents.join(kb.raw("labels").select("doc_id"), "doc_id", "left_semi").withColumns(
        {"title": F.concat(F.lit("old "), "title"), "updated_at": F.col("created_at"), "status": F.lit("uploaded")})
    return old, kb.documents.filter("n_chars > 500")


@query("inc06_upsert_documents", f"""
WITH o AS (SELECT * FROM kb_documents SEMI JOIN labels USING (doc_id)), n AS (SELECT * FROM kb_documents WHERE n_chars > 500)
SELECT tenant_id, document_id, coalesce(n.title, 'old ' || o.title) AS title, coalesce(n.source_uri, o.source_uri) AS source_uri,
       coalesce(n.depth, o.depth) AS depth, coalesce(n.page_count, o.page_count) AS page_count,
       CASE WHEN o.doc_id IS NOT NULL THEN 'uploaded' ELSE n.status END AS status,
       CASE WHEN n.doc_id IS NOT NULL THEN {NOW:.1f}::DOUBLE ELSE o.created_at END AS updated_at
FROM o FULL JOIN n USING (tenant_id, document_id)""")
def _(kb):
    return inc.upsert_documents(*old_and_new_documents(kb), NOW)


@query("inc07_upsert_spans", """
SELECT s.tenant_id, s.span_id, CASE WHEN d.n_chars > 500 THEN 'v2 ' || s.content ELSE s.content END AS content
FROM kb_spans s JOIN kb_documents d USING (tenant_id, document_id)
WHERE d.n_chars > 500 OR s.doc_id IN (SELECT doc_id FROM labels)""")
def _(kb):
    old, new = old_and_new_documents(kb)
    key = ["tenant_id", "document_id"]
    base = kb.spans.join(old.select(*key), key, "left_semi").withColumn("seq", F.lit(1))
    fresh = kb.spans.join(new.select(*key), key, "left_semi").withColumns(
        {"seq": F.lit(2), "content": F.concat(F.lit("v2 "), "content")})
    return inc.latest_wins(base, fresh, ["tenant_id", "span_id"], ["content"])


@query("inc08_status_fold", """
SELECT tenant_id, 'doc_' || user_id AS document_id, arg_max(action, (ts, seq)) AS status,
       left(arg_max(repeat(target, 500), (ts, seq)), 4000) AS compile_error, max(ts) AS updated_at
FROM kb_audit GROUP BY 1, 2""")
def _(kb):
    ev = kb.audit.select("tenant_id", tx.cat("doc_", F.col("user_id")).alias("document_id"), F.col("action").alias("status"),
                         F.repeat("target", F.lit(500)).alias("error"), "ts", "seq")
    return inc.fold_status(ev)


@query("inc09_level_done", """
SELECT 'j' || l_orderkey AS job_id, l_linestatus AS level, count(*) AS expected,
       count(*) FILTER (l_returnflag <> 'N') AS done, count(*) FILTER (l_returnflag <> 'N') >= count(*) AS complete
FROM lineitem GROUP BY 1, 2""")
def _(kb):
    units = kb.raw("lineitem").select(tx.cat("j", F.col("l_orderkey")).alias("job_id"),
                                      F.col("l_linestatus").alias("level"), "l_returnflag")
    want = units.groupBy("job_id", "level").agg(F.count(F.lit(1)).alias("expected"))
    return inc.level_done(units.filter("l_returnflag <> 'N'"), want)


@query("inc10_batch_routing", """
SELECT tenant_id, span_id, n FROM (SELECT tenant_id, span_id, count(*) OVER (PARTITION BY document_id) AS n FROM kb_spans) WHERE n >= 30""")
def _(kb):
    return inc.batch_documents(kb.spans.select("tenant_id", "document_id", "span_id")).select("tenant_id", "span_id", "n")


@query("inc11_compile_summary", """
SELECT d.tenant_id, d.document_id, coalesce(c.n, 0) AS chunks, coalesce(s.n, 0) AS spans, coalesce(f.n, 0) AS facts,
       coalesce(e.n, 0) AS entities, coalesce(f.amb, 0) AS ambiguous
FROM kb_documents d
LEFT JOIN (SELECT document_id, count(*) AS n FROM kb_chunks GROUP BY 1) c USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n FROM kb_spans GROUP BY 1) s USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (provenance = 'ambiguous') AS amb FROM kb_facts GROUP BY 1) f USING (document_id)
LEFT JOIN (SELECT document_id, count(*) AS n FROM kb_entities GROUP BY 1) e USING (document_id)""")
def _(kb):
    return inc.compile_summary(kb.documents, chunks=kb.chunks, spans=kb.spans, facts=kb.facts, entities=kb.entities,
                               ambiguous=kb.facts.filter("provenance = 'ambiguous'"))


@query("inc12_newest_documents", """
SELECT * FROM (SELECT tenant_id, document_id, title, status, row_number() OVER (PARTITION BY tenant_id
  ORDER BY created_at DESC, document_id) AS rank FROM kb_documents) WHERE rank <= 50""")
def _(kb):
    return inc.newest_documents(kb.documents).select("tenant_id", "document_id", "title", "status", "rank")
