"""Knowledge tables over the driver tables, as DuckDB SQL (the oracle side).

``fixtures.Kb`` builds the same tables with DataFrames.
"""

NOW = 1009843200.0

TABLES: dict[str, str] = {}

TABLES["kb_documents"] = """
SELECT 't' || (doc_id % 4) AS tenant_id, 'doc_' || doc_id AS document_id, doc_id,
       source || '/' || doc_id AS title, source AS source_uri, 'queryable_full' AS status,
       'D' || (doc_id % 3) AS depth, CAST(1 + n_chars // 1800 AS BIGINT) AS page_count,
       CAST(1704067200 + doc_id * 60 AS DOUBLE) AS created_at, text AS content, n_chars
FROM documents"""

TABLES["kb_spans"] = """
SELECT 't' || (doc_id % 4) AS tenant_id, 'doc_' || doc_id AS document_id, 'ch_' || doc_id AS chunk_id,
       'sp_' || doc_id || '_' || i AS span_id, CAST(i AS BIGINT) AS span_no, content,
       'text' AS span_type, CAST(1 + (i - 1) // 10 AS BIGINT) AS page, doc_id
FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i,
             unnest(string_split(text, chr(10))) AS content FROM documents)"""

TABLES["kb_chunks"] = """
SELECT 't' || (doc_id % 4) AS tenant_id, 'doc_' || doc_id AS document_id, 'ch_' || doc_id AS chunk_id,
       text AS content, source AS section_path,
       sha256(text || chr(0) || 'v1' || chr(0)) AS content_hash,
       CASE WHEN length(s) > 200 THEN left(s, 197) || '...' ELSE s END AS summary,
       CASE doc_id % 4 WHEN 0 THEN 'core' WHEN 1 THEN 'supporting' WHEN 2 THEN 'peripheral' END AS tier,
       CAST(1 AS BIGINT) AS page_start, doc_id
FROM (SELECT *, replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' ') AS s FROM documents)"""

TABLES["kb_entities"] = """
SELECT e.tenant_id, e.entity_id, e.name, e.type, e.aliases, 'doc_' || e.doc_no AS document_id,
       'sp_' || e.doc_no || '_1' AS mention_span_id,
       CASE WHEN e.type = 'product' THEN v.embedding END AS embedding
FROM (
  SELECT 't' || (p_partkey % 4) AS tenant_id, 'part_' || p_partkey AS entity_id, p_name AS name,
         'product' AS type, [p_name || ' ' || p_brand] AS aliases, p_partkey AS doc_no FROM part
  UNION ALL
  SELECT 't' || t, 'supp_' || t || '_' || s_suppkey, s_name, 'org', [], s_suppkey * 4 + t
  FROM supplier, range(4) g(t)
  UNION ALL
  SELECT 't' || t, 'nat_' || t || '_' || n_nationkey, n_name, 'location', [], n_nationkey * 4 + t
  FROM nation, range(4) g(t)
  UNION ALL
  SELECT 't' || (c_custkey % 4), 'cust_' || c_custkey, c_name, 'person', [], c_custkey FROM customer
) e LEFT JOIN embeddings v ON e.type = 'product' AND v.vec_id = e.doc_no"""

_KEY = """concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(epoch(l_shipdate) AS BIGINT), l_quantity)"""

TABLES["kb_sightings"] = f"""
SELECT 't' || (l_partkey % 4) AS tenant_id, 'supp_' || (l_partkey % 4) || '_' || l_suppkey AS source_entity,
       CASE WHEN l_linestatus = 'O' THEN 'owns' ELSE 'develops' END AS relation_type,
       'part_' || l_partkey AS target_entity, 'sp_' || l_partkey || '_' || l_linenumber AS span_id,
       {_KEY} AS seq, epoch(l_shipdate) AS seen_at
FROM lineitem
UNION ALL
SELECT 't' || (c_custkey % 4), 'cust_' || c_custkey, 'belongs_to',
       'nat_' || (c_custkey % 4) || '_' || c_nationkey, 'sp_' || c_custkey || '_1',
       'c' || c_custkey, 0.0
FROM customer WHERE c_acctbal >= 0"""

TABLES["kb_edges"] = """
SELECT 'rl_' || left(sha256(tenant_id || ':' || source_entity || ':' || relation_type || ':' || target_entity), 16)
         AS relation_id, tenant_id, source_entity, relation_type, target_entity,
       count(*) AS source_count,
       CASE WHEN count(*) > 1 THEN 1.0 - 1.0 / (1.0 + count(*)) ELSE 1.0 END AS confidence
FROM kb_sightings GROUP BY tenant_id, source_entity, relation_type, target_entity"""

TABLES["kb_edge_spans"] = """
SELECT DISTINCT 'rl_' || left(sha256(tenant_id || ':' || source_entity || ':' || relation_type || ':' || target_entity), 16)
         AS relation_id, tenant_id, span_id
FROM kb_sightings"""

TABLES["kb_facts"] = f"""
WITH l AS (
  SELECT *, sha256({_KEY}) AS k, CAST(l_quantity AS BIGINT) % 10 AS q,
         (CASE WHEN l_linestatus = 'O' THEN 'depends_on_' ELSE 'status_' END) || year(l_shipdate) AS pred,
         'sp_' || l_partkey || '_' || l_linenumber AS span_id
  FROM lineitem)
SELECT 't' || (l_partkey % 4) AS tenant_id, k || 'p' AS fact_id, 'doc_' || l_partkey AS document_id,
       'part_' || l_partkey AS subject_entity, pred AS predicate, l_returnflag AS object_value,
       CASE WHEN q < 2 THEN 'inferred' WHEN q < 4 THEN 'ambiguous' ELSE 'extracted' END AS provenance,
       CAST(l_linenumber AS BIGINT) AS source_count, epoch(l_shipdate) AS created_at,
       epoch(l_shipdate) AS last_confirmed, l_tax > 0.07 AS stale,
       CASE WHEN q < 2 AND l_discount > 0.05 THEN NULL ELSE span_id END AS span_id
FROM l
UNION ALL
SELECT 't' || (l_partkey % 4), k || 's', 'doc_' || (l_suppkey * 4 + l_partkey % 4),
       'supp_' || (l_partkey % 4) || '_' || l_suppkey, pred, l_returnflag,
       CASE WHEN q < (CASE WHEN l_suppkey % 10 = 0 THEN 6 ELSE 1 END) THEN 'inferred'
            WHEN q >= 8 THEN 'ambiguous' ELSE 'extracted' END,
       CAST(l_linenumber AS BIGINT), epoch(l_shipdate), epoch(l_shipdate), l_tax > 0.07,
       CASE WHEN q < (CASE WHEN l_suppkey % 10 = 0 THEN 6 ELSE 1 END) AND l_discount > 0.05
            THEN NULL ELSE span_id END
FROM l"""

TABLES["kb_concepts"] = """
SELECT DISTINCT tenant_id, 'con_' || tenant_id || '_' || word AS entity_id, word AS name, 'concept' AS type
FROM (SELECT 't' || (item_id % 4) AS tenant_id,
             unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark)"""

TABLES["kb_named"] = """
SELECT tenant_id, entity_id, name, type FROM kb_entities UNION ALL SELECT tenant_id, entity_id, name, type FROM kb_concepts"""

TABLES["kb_questions"] = """
SELECT 't' || (item_id % 4) AS tenant_id, 'q_' || item_id || '_' || i AS qid, item_id,
       CASE item_id % 5 WHEN 0 THEN 'detail' WHEN 1 THEN 'table' WHEN 2 THEN 'multi_doc'
            WHEN 3 THEN 'long_doc' ELSE 'summary' END AS bucket, question
FROM (SELECT item_id, generate_subscripts(parts, 1) AS i, trim(unnest(parts), ' ' || chr(10) || chr(9)) AS question
      FROM (SELECT item_id, string_split(regexp_replace(text, '([。.!?！？])\\s*', '\\1' || chr(1), 'g'), chr(1)) AS parts
            FROM benchmark))
WHERE question <> ''"""

TABLES["kb_sentences"] = """
SELECT tenant_id, document_id, span_id, trim(unnest(string_split(
         regexp_replace(content, '([。.!?！？])\\s*', '\\1' || chr(1), 'g'), chr(1))), ' ' || chr(10) || chr(9)) AS sentence
FROM kb_spans"""

TABLES["kb_gold"] = """
SELECT DISTINCT q.qid, s.span_id FROM kb_questions q JOIN kb_sentences s
  ON s.tenant_id = q.tenant_id AND s.sentence = q.question"""

TABLES["kb_query_vectors"] = """
SELECT CAST(label AS BIGINT) AS label, list(m ORDER BY j) AS vector
FROM (SELECT label, j, round(avg(x), 6) AS m
      FROM (SELECT label, generate_subscripts(embedding, 1) AS j, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
      GROUP BY label, j)
GROUP BY label"""

TABLES["kb_turns"] = """
SELECT 't' || (conv_id % 4) AS tenant_id, 'u' || (conv_id % 50) AS user_id, 's' || conv_id AS session_id,
       conv_id, turn, role, text, CAST(1704067200 + conv_id * 86400 + turn * 60 AS BIGINT) AS ts
FROM conversations"""

TABLES["kb_answers"] = """
SELECT tenant_id, 'a_' || conv_id || '_' || turn AS answer_id, conv_id, turn,
       CASE WHEN (conv_id + turn) % 5 = 0 OR NOT text LIKE '%.' THEN text
            ELSE left(text, length(text) - 1) || ' [doc_' || conv_id || ':sp_' || conv_id || '_' ||
                 (CASE WHEN (conv_id + turn) % 7 = 0 THEN 99999 ELSE 1 END) || '].' END AS answer
FROM kb_turns WHERE role = 'assistant'"""

TABLES["kb_claims"] = """
SELECT tenant_id, answer_id, conv_id, turn, CAST(i AS BIGINT) AS claim_no, claim
FROM (SELECT tenant_id, answer_id, conv_id, turn, generate_subscripts(parts, 1) AS i,
             trim(unnest(parts), ' ' || chr(10) || chr(9)) AS claim
      FROM (SELECT *, string_split(regexp_replace(answer, '([。.!?！？])\\s*', '\\1' || chr(1), 'g'), chr(1)) AS parts
            FROM kb_answers))
WHERE claim <> ''"""

TABLES["kb_citations"] = """
SELECT DISTINCT tenant_id, answer_id, conv_id, turn, claim_no, c[1] AS doc_id, c[2] AS span_id
FROM (SELECT tenant_id, answer_id, conv_id, turn, claim_no,
             string_split(replace(replace(unnest(regexp_extract_all(claim, '\\[[\\w\\-]+:[\\w\\-]+\\]')), '[', ''), ']', ''), ':') AS c
      FROM kb_claims)"""

TABLES["kb_entailment"] = """
SELECT DISTINCT tenant_id, answer_id, claim_no, span_id, (conv_id + turn) % 2 = 0 AS entailed,
       ((conv_id + turn * 3) % 10) / 10.0 AS score
FROM kb_citations"""

TABLES["kb_observations"] = """
SELECT tenant_id, user_id, session_id, 'ob_' || conv_id || '_' || turn AS obs_id,
       CASE WHEN role = 'user' THEN 'episodic' ELSE 'semantic' END AS tier, text AS content,
       CASE WHEN role = 'user' THEN 0.6 ELSE 0.8 END AS confidence, ts AS created_at
FROM kb_turns WHERE role IN ('user', 'assistant')"""

TABLES["kb_audit"] = """
SELECT 't' || (user_id % 4) AS tenant_id, 'u' || user_id AS user_id, event_type AS action,
       props AS target, epoch_us(ts) / 1000000.0 AS ts, event_id AS seq, value FROM events"""

TABLES["kb_manifest"] = """
SELECT c.tenant_id, c.document_id, c.chunk_id,
       CASE WHEN l.quality = 1 THEN c.content_hash ELSE sha256('old' || c.content_hash) END AS content_hash,
       'ft_' || c.doc_id AS fact_id, 'part_' || c.doc_id AS entity_id, 'wk_' || c.doc_id AS wiki_node_id
FROM kb_chunks c JOIN labels l ON l.doc_id = c.doc_id"""

TABLES["kb_settings"] = """
SELECT * FROM (VALUES ('t0', NULL, NULL, NULL), ('t1', 0.25, NULL, 120), ('t2', NULL, 0.5, 80))
  AS s(tenant_id, lint_ambiguous_ratio, lint_hub_inferred_ratio, summary_max_chars)"""

TABLES["kb_mentions"] = """
SELECT h.tenant_id, c.entity_id, c.name, h.span_id, h.document_id
FROM (SELECT n.tenant_id, n.needle, s.span_id, s.document_id
      FROM (SELECT DISTINCT tenant_id, lower(name) AS needle FROM kb_named WHERE length(name) >= 3 AND trim(name) <> '') n
      JOIN kb_spans s ON s.tenant_id = n.tenant_id AND contains(lower(s.content), n.needle)) h
JOIN kb_named c ON c.tenant_id = h.tenant_id AND lower(c.name) = h.needle"""

TABLES["kb_degrees"] = """
SELECT e.tenant_id, e.entity_id, e.name, e.type, coalesce(d.deg, 0) AS degree
FROM kb_entities e LEFT JOIN (
  SELECT tenant_id, ent, count(*) AS deg FROM (
    SELECT tenant_id, source_entity AS ent FROM kb_edges
    UNION ALL SELECT tenant_id, target_entity FROM kb_edges) GROUP BY 1, 2) d
  ON d.tenant_id = e.tenant_id AND d.ent = e.entity_id"""

TABLES["kb_page_text"] = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS content
FROM (SELECT page_id,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(html, '(?is)<!--.*?-->', '', 'g'),
    '(?is)<(script|style|head)\b.*?</(script|style|head)>', '', 'g'),
    '(?i)<h1[^>]*>', chr(10) || chr(10) || '# ', 'g'), '(?i)<h2[^>]*>', chr(10) || chr(10) || '## ', 'g'),
    '(?i)<h3[^>]*>', chr(10) || chr(10) || '### ', 'g'), '(?i)<li[^>]*>', chr(10) || '- ', 'g'),
    '(?i)</(h[1-6]|p|div|ul|ol|nav|article|section)>', chr(10) || chr(10), 'g'),
    '(?i)<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g') AS x FROM pages)"""


def _redaction_sql() -> str:
    steps = [
        (r"sk-[A-Za-z0-9]{16,}", "[REDACTED_API_KEY]"),
        (r"(?i)bearer\s+[A-Za-z0-9._\-]{16,}", "[REDACTED_TOKEN]"),
        (r"(?i)(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S+", r"\1: [REDACTED]"),
        (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]"),
        (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
        (r"\b(?:\+?86)?1[3-9]\d{9}\b", "[REDACTED_PHONE]"),
        (r"\b\d{17}[\dXx]\b", "[REDACTED_ID]"),
        (r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
    ]
    sql = "SELECT doc_id, source, text AS t0 FROM documents"
    for i, (pattern, placeholder) in enumerate(steps, 1):
        sql = (f"SELECT *, len(regexp_extract_all(t{i - 1}, '{pattern}')) AS h{i}, "
               f"regexp_replace(t{i - 1}, '{pattern}', '{placeholder}', 'g') AS t{i} FROM ({sql})")
    return f"SELECT doc_id, source, t8 AS clean, h1 + h2 + h3 + h4 + h5 + h6 + h7 + h8 AS hits, h1, h2, h3, h4, h5, h6, h7, h8 FROM ({sql})"


TABLES["kb_redacted"] = _redaction_sql()

TABLES["kb_new"] = """
SELECT 't' || (p_partkey % 4) AS tenant_id, 'new_' || p_partkey AS entity_id, p_partkey AS k, p_size, 'product' AS type,
       CASE WHEN p_size <= 12 THEN upper(p_name) WHEN p_size <= 25 THEN p_name || ' ' || p_brand
            WHEN p_size <= 38 THEN p_name || 's' ELSE p_name || ' of ' || p_type END AS name,
       list_transform(range(1, len(v) + 1), lambda i: v[i] + 0.4 * v[len(v) - i + 1]) AS embedding
FROM part LEFT JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) ON vec_id = p_partkey"""

BLOCK_SQL = "left(regexp_replace(lower(split_part(name, ' ', 1)), '[^\\w]', '', 'g'), 8) || '|' || type"

TABLES["kb_known"] = f"""
SELECT tenant_id, entity_id, name, lower(name) AS name_key, type, aliases, CAST(embedding AS DOUBLE[]) AS embedding,
       {BLOCK_SQL} AS name_block FROM kb_entities"""

TABLES["kb_incoming"] = f"SELECT *, lower(name) AS name_key, {BLOCK_SQL} AS name_block FROM kb_new"

TABLES["kb_close"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY round(sim, 9) DESC, canonical_id) AS rank
FROM (SELECT n.tenant_id, n.entity_id, e.entity_id AS canonical_id, list_dot_product(n.embedding, e.embedding) /
        (sqrt(list_dot_product(n.embedding, n.embedding)) * sqrt(list_dot_product(e.embedding, e.embedding)) + 1e-9) AS sim
      FROM kb_incoming n JOIN kb_known e ON e.tenant_id = n.tenant_id AND e.name_block = n.name_block
      WHERE n.embedding IS NOT NULL AND e.embedding IS NOT NULL) WHERE sim > 0.85) WHERE rank <= 2"""

TABLES["kb_question_vectors"] = """
SELECT q.*, CAST(e.embedding AS DOUBLE[]) AS vector FROM kb_questions q JOIN embeddings e ON e.vec_id = q.item_id"""

TABLES["kb_span_vectors"] = """
SELECT s.tenant_id, s.span_id, s.document_id, CAST(e.embedding AS DOUBLE[]) AS embedding
FROM kb_spans s JOIN embeddings e ON e.vec_id = s.doc_id WHERE s.span_no = 1"""

TABLES["kb_vector_stream"] = """
SELECT tenant_id, qid, span_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, span_id) AS rank
  FROM (SELECT q.tenant_id, q.qid, s.span_id, list_cosine_similarity(q.vector, s.embedding) AS score
        FROM kb_question_vectors q JOIN kb_span_vectors s USING (tenant_id))) WHERE rank <= 50"""

TABLES["kb_postings"] = """
SELECT tenant_id, span_id, term, doc_len, count(*) AS tf
FROM (SELECT tenant_id, span_id, len(t) AS doc_len, unnest(t) AS term
      FROM (SELECT tenant_id, span_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') AS t FROM kb_spans))
GROUP BY 1, 2, 3, 4"""

TABLES["kb_question_terms"] = """
SELECT DISTINCT tenant_id, qid, n, unnest(t) AS term FROM (
  SELECT tenant_id, qid, t, len(list_distinct(t)) AS n
  FROM (SELECT tenant_id, qid, regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+') AS t FROM kb_questions))"""

TABLES["kb_text_stream"] = """
SELECT tenant_id, qid, span_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, span_id) AS rank FROM (
    SELECT q.tenant_id, q.qid, p.span_id, sum(ln(1 + (c.n_spans - d.df + 0.5) / (d.df + 0.5)) * p.tf * 2.2
             / (p.tf + 1.2 * (0.25 + 0.75 * p.doc_len / c.avg_len))) AS score
    FROM kb_question_terms q JOIN kb_postings p USING (tenant_id, term)
    JOIN (SELECT tenant_id, term, count(*) AS df FROM kb_postings GROUP BY 1, 2) d USING (tenant_id, term)
    JOIN (SELECT tenant_id, count(*) AS n_spans, avg(len(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'))) AS avg_len
          FROM kb_spans GROUP BY 1) c USING (tenant_id)
    GROUP BY q.tenant_id, q.qid, q.n, p.span_id HAVING count(*) = q.n)) WHERE rank <= 50"""

_TRI = """list_distinct(flatten(list_transform(list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+')),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"""

TABLES["kb_trigram_stream"] = f"""
WITH s AS (SELECT tenant_id, span_id, len(g) AS sn, unnest(g) AS g FROM (SELECT tenant_id, span_id, {_TRI.format(c='content')} AS g FROM kb_spans)),
q AS (SELECT tenant_id, qid, len(g) AS qn, unnest(g) AS g FROM (SELECT tenant_id, qid, {_TRI.format(c='question')} AS g FROM kb_questions)),
m AS (SELECT tenant_id, qid, span_id, count(*) / (any_value(sn) + any_value(qn) - count(*)) AS score
      FROM q JOIN s USING (tenant_id, g) GROUP BY 1, 2, 3)
SELECT tenant_id, qid, span_id, score, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, span_id) AS rank FROM m WHERE score >= 0.3) WHERE rank <= 50"""

TABLES["kb_linked"] = """
SELECT tenant_id, qid, entity_id, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, qid ORDER BY round(sim, 9) DESC, entity_id) AS rank
  FROM (SELECT q.tenant_id, q.qid, e.entity_id, list_cosine_similarity(q.vector, CAST(e.embedding AS DOUBLE[])) AS sim
        FROM kb_question_vectors q JOIN kb_entities e ON e.tenant_id = q.tenant_id AND e.embedding IS NOT NULL)) WHERE rank <= 5
UNION
SELECT q.tenant_id, q.qid, e.entity_id, 1.0 FROM kb_questions q JOIN kb_entities e
  ON e.tenant_id = q.tenant_id AND contains(lower(e.name), lower(q.question))"""

TABLES["kb_graph_stream"] = """
SELECT tenant_id, qid, span_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, span_id) AS rank
  FROM (SELECT l.tenant_id, l.qid, x.span_id, max(e.confidence) AS score
        FROM kb_linked l JOIN kb_edges e ON e.tenant_id = l.tenant_id AND l.entity_id IN (e.source_entity, e.target_entity)
        JOIN kb_edge_spans x ON x.relation_id = e.relation_id
        WHERE x.span_id IN (SELECT span_id FROM kb_spans) GROUP BY 1, 2, 3)) WHERE rank <= 50"""

TABLES["kb_fused"] = """
SELECT tenant_id, qid, span_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, span_id) AS rank
  FROM (SELECT tenant_id, qid, span_id, sum(1.0 / (60 + rank)) AS score FROM (
          SELECT tenant_id, qid, span_id, rank FROM kb_vector_stream UNION ALL
          SELECT tenant_id, qid, span_id, rank FROM kb_text_stream UNION ALL
          SELECT tenant_id, qid, span_id, rank FROM kb_trigram_stream UNION ALL
          SELECT tenant_id, qid, span_id, rank FROM kb_graph_stream)
        GROUP BY 1, 2, 3)) WHERE rank <= 50"""

TABLES["kb_reranked"] = """
SELECT tenant_id, qid, span_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, fused_rank) AS rank
  FROM (SELECT f.tenant_id, f.qid, f.span_id, f.rank AS fused_rank,
               coalesce(CASE WHEN s.span_no <= 5 THEN (length(s.content) % 10) / 10.0 END,
                        1.0 / count(*) OVER (PARTITION BY f.tenant_id, f.qid)) AS score
        FROM kb_fused f JOIN kb_spans s USING (tenant_id, span_id))) WHERE rank <= 16"""

TABLES["kb_results"] = """
SELECT tenant_id, qid, span_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, qid ORDER BY round(score, 9) DESC, before) AS rank
  FROM (SELECT r.tenant_id, r.qid, r.span_id, r.rank AS before,
               r.score * CASE c.tier WHEN 'core' THEN 1.0 WHEN 'supporting' THEN 0.7 WHEN 'peripheral' THEN 0.3 ELSE 0.7 END AS score
        FROM kb_reranked r JOIN kb_spans s USING (tenant_id, span_id) JOIN kb_chunks c USING (tenant_id, chunk_id))) WHERE rank <= 8"""
