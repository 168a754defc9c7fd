"""Citation, verification, memory, governance and wiki queries."""

from pyspark.sql import functions as F

from sparklore.operators import evaluation as ev
from sparklore.operators import extraction as ext
from sparklore.operators import governance as gov
from sparklore.operators import memory as mem
from sparklore.operators import retrieval as ret
from sparklore.operators import wiki
from sparklore.plans.registry import query
from sparklore.sources import corpus

R = F.round


def claim_rows(kb):
    return ev.split_claims(kb.answers)


def entailment(kb):
    """Outside entailment scores of each cited claim."""
    n = F.col("conv_id") + F.col("turn")
    return claim_rows(kb).select("tenant_id", "answer_id", "claim_no", F.explode("cites").alias("c"),
                                 (n % 2 == 0).alias("entailed"),
                                 ((F.col("conv_id") + F.col("turn") * 3) % 10 / 10.0).alias("score")).select(
        "tenant_id", "answer_id", "claim_no", "c.span_id", "entailed", "score").distinct()


def verified(kb):
    return ev.verify_claims(claim_rows(kb), kb.spans, entailment(kb))


VERDICTS = """
WITH ok AS (SELECT c.answer_id, c.claim_no, bool_or(e.entailed AND e.score >= 0.5) AS good FROM kb_citations c
  JOIN kb_spans s ON s.tenant_id = c.tenant_id AND s.document_id = c.doc_id AND s.span_id = c.span_id
  LEFT JOIN kb_entailment e ON e.answer_id = c.answer_id AND e.claim_no = c.claim_no AND e.span_id = c.span_id GROUP BY 1, 2),
v AS (SELECT c.tenant_id, c.answer_id, c.conv_id, c.turn, c.claim_no, c.claim,
        CASE WHEN EXISTS (SELECT 1 FROM kb_citations x WHERE x.answer_id = c.answer_id AND x.claim_no = c.claim_no)
             THEN coalesce(ok.good, false) END AS verified
      FROM kb_claims c LEFT JOIN ok USING (answer_id, claim_no)),
a AS (SELECT tenant_id, answer_id, conv_id, turn, count(*) AS claims, count(verified) AS cited, count(*) FILTER (verified) AS verified,
        coalesce(count(*) FILTER (verified) / nullif(count(verified), 0), 0) AS verified_ratio FROM v GROUP BY 1, 2, 3, 4)
"""


@query("evl01_citations", """
SELECT DISTINCT tenant_id, answer_id, doc_id AS document_id, span_id FROM kb_citations""")
def _(kb):
    return ev.extract_citations(kb.answers).select("tenant_id", "answer_id", "document_id", "span_id")


@query("evl02_claims", """
SELECT c.tenant_id, c.answer_id, c.claim, (SELECT count(*) FROM kb_citations x WHERE x.answer_id = c.answer_id AND x.claim_no = c.claim_no) AS n_cites
FROM kb_claims c""")
def _(kb):
    return claim_rows(kb).select("tenant_id", "answer_id", "claim", F.size("cites").cast("long").alias("n_cites"))


@query("evl03_resolve_citations", """
SELECT c.tenant_id, c.answer_id, c.doc_id AS document_id, c.span_id, s.span_id IS NOT NULL AS resolved FROM kb_citations c
LEFT JOIN kb_spans s ON s.tenant_id = c.tenant_id AND s.document_id = c.doc_id AND s.span_id = c.span_id""")
def _(kb):
    return ev.resolve_citations(ev.cited_spans(claim_rows(kb)), kb.spans).select(
        "tenant_id", "answer_id", "document_id", "span_id", "resolved")


@query("evl04_claim_verdicts", VERDICTS + "SELECT tenant_id, answer_id, claim, verified FROM v")
def _(kb):
    return verified(kb).select("tenant_id", "answer_id", "claim", "verified")


@query("evl05_answer_verdicts", VERDICTS + """
SELECT tenant_id, answer_id, claims, cited, verified, round(verified_ratio, 6) AS verified_ratio,
       cited > 0 AND verified_ratio >= 0.6 AS sufficient FROM a""")
def _(kb):
    return ev.verify_answers(verified(kb)).withColumn("verified_ratio", R("verified_ratio", 6))


def routed(kb):
    return kb.answers.withColumn("route", F.when(F.length("answer") < 600, "simple").otherwise("complex"))


@query("evl06_escalations", VERDICTS + """
SELECT a.tenant_id, a.answer_id FROM a JOIN kb_answers k USING (tenant_id, answer_id)
WHERE length(k.answer) < 600 AND NOT (cited > 0 AND verified_ratio >= 0.6)""")
def _(kb):
    return ev.escalations(routed(kb), ev.verify_answers(verified(kb))).select("tenant_id", "answer_id")


QUALITY = """
SELECT bucket, count(*) AS n, round(avg(CASE WHEN h IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall_at_k,
       round(avg(CASE WHEN h IS NULL THEN 0.0 ELSE 1.0 / h END), 6) AS mrr
FROM kb_questions q LEFT JOIN (SELECT r.qid, min(r.rank) AS h FROM {stream} r JOIN kb_gold g USING (qid, span_id)
  WHERE r.rank <= 8 GROUP BY 1) USING (qid) GROUP BY 1"""


def measured(kb, stream):
    q = ev.retrieval_quality(kb.questions, stream, kb.gold)
    return q.withColumns({"recall_at_k": R("recall_at_k", 6), "mrr": R("mrr", 6)})


@query("evl07_retrieval_quality", QUALITY.format(stream="kb_text_stream"))
def _(kb):
    return measured(kb, ret.text_stream(kb.questions, kb.search_index))


def answer_buckets(kb):
    return kb.answers.select("tenant_id", "answer_id", F.when(F.col("turn") <= 2, "short").otherwise("long").alias("bucket"))


@query("evl08_faithfulness", VERDICTS + """
SELECT CASE WHEN k.turn <= 2 THEN 'short' ELSE 'long' END AS bucket, count(*) AS n,
       round(avg(coalesce(a.verified_ratio, 0)), 6) AS faithfulness
FROM kb_answers k LEFT JOIN a USING (tenant_id, answer_id) GROUP BY 1""")
def _(kb):
    return ev.faithfulness(answer_buckets(kb), ev.verify_answers(verified(kb))).withColumn(
        "faithfulness", R("faithfulness", 6))


@query("evl09_metric_diff", "WITH b AS (" + QUALITY.format(stream="kb_text_stream") + "), n AS (" +
       QUALITY.format(stream="kb_vector_stream") + """)
SELECT bucket, metric, before, after, round(after - before, 6) AS change FROM (
  SELECT bucket, 'recall_at_k' AS metric, b.recall_at_k AS before, n.recall_at_k AS after FROM b FULL JOIN n USING (bucket)
  UNION ALL SELECT bucket, 'mrr', b.mrr, n.mrr FROM b FULL JOIN n USING (bucket))""")
def _(kb):
    old = measured(kb, ret.text_stream(kb.questions, kb.search_index))
    new = measured(kb, ret.vector_stream(kb.question_vectors, kb.spans_with_vectors))
    return ev.metric_diff(old, new, "bucket", ["recall_at_k", "mrr"]).withColumn("change", R("change", 6))


LAST = """last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id, session_id ORDER BY turn DESC) AS back,
  count(*) OVER (PARTITION BY tenant_id, user_id, session_id) AS n FROM kb_turns) WHERE back <= {k})"""


@query("mem01_last_turns", "WITH " + LAST.format(k=20) + """
SELECT tenant_id, session_id, turn, role, least(n, 20) - back + 1 AS pos FROM last""")
def _(kb):
    return mem.last_turns(kb.turns).select("tenant_id", "session_id", "turn", "role", "pos")


@query("mem02_transcripts", "WITH " + LAST.format(k=20) + """
SELECT tenant_id, user_id, session_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM last GROUP BY 1, 2, 3""")
def _(kb):
    return mem.transcripts(kb.turns)


@query("mem03_observations_of_lines", """
SELECT tenant_id, session_id, turn, content, 'episodic' AS tier, CAST(0.6 AS DOUBLE) AS confidence FROM (
  SELECT tenant_id, session_id, turn, raw, trim(regexp_replace(raw, '^[-• ]+|[-• ]+$', '', 'g')) AS content FROM (
    SELECT tenant_id, session_id, turn, unnest(string_split(text, chr(10))) AS raw FROM kb_turns WHERE role = 'assistant'))
WHERE trim(raw) <> ''""")
def _(kb):
    answers = kb.turns.filter("role = 'assistant'").select("tenant_id", "session_id", "turn", F.col("text").alias("response"))
    return mem.observations_of(answers, "episodic").select(
        "tenant_id", "session_id", "turn", "content", "tier", "confidence")


def open_observations(kb):
    return kb.observations.withColumn("promoted_to", F.lit(None).cast("string"))


BATCH = """batch AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY tenant_id) AS n,
  row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, obs_id) AS pos FROM kb_observations WHERE tier = '{tier}')
  WHERE n >= {gate})"""


@query("mem04_promotion_requests", "WITH " + BATCH.format(tier="semantic", gate=8) + """
SELECT tenant_id, CAST((pos - 1) // 200 AS BIGINT) AS batch_no, string_agg(content, chr(10) ORDER BY pos) AS request FROM batch GROUP BY 1, 2""")
def _(kb):
    return mem.promotion_requests(mem.promotion_batch(open_observations(kb), "semantic"))


@query("mem04_episodic_requests", "WITH " + BATCH.format(tier="episodic", gate=5) + """
SELECT tenant_id, CAST((pos - 1) // 100 AS BIGINT) AS batch_no, string_agg(content, chr(10) ORDER BY pos) AS request FROM batch GROUP BY 1, 2""")
def _(kb):
    return mem.promotion_requests(mem.promotion_batch(open_observations(kb), "episodic"))


def workflow_lines(kb):
    """Order flows as workflow lines; open orders have no step and must drop out."""
    o = kb.raw("orders")
    return o.select("o_orderkey", F.concat(
        "o_orderpriority", F.when(F.col("o_orderstatus") == "O", " then ").otherwise(" => check -> "),
        F.lit("ship "), F.col("o_custkey").cast("string")).alias("content"))


@query("mem05_workflows", """
SELECT o_orderkey, o_orderpriority AS "trigger", 'check|ship ' || o_custkey AS steps FROM orders WHERE o_orderstatus <> 'O'""")
def _(kb):
    return mem.workflows(workflow_lines(kb)).select("o_orderkey", "trigger", F.array_join("steps", "|").alias("steps"))


@query("mem06_mark_promoted", "WITH " + BATCH.format(tier="semantic", gate=8) + """,
first AS (SELECT tenant_id, min(obs_id) AS product FROM kb_observations WHERE tier = 'episodic' GROUP BY 1)
SELECT o.tenant_id, o.obs_id, CASE WHEN b.obs_id IS NOT NULL THEN f.product END AS promoted_to
FROM kb_observations o LEFT JOIN batch b USING (tenant_id, obs_id) LEFT JOIN first f USING (tenant_id)""")
def _(kb):
    obs = open_observations(kb)
    products = obs.filter("tier = 'episodic'").withColumn("line_no", F.col("obs_id"))
    return mem.mark_promoted(obs, mem.promotion_batch(obs, "semantic"), products).select(
        "tenant_id", "obs_id", "promoted_to")


@query("mem07_recent_context", """
SELECT tenant_id, user_id, string_agg('- ' || content, chr(10) ORDER BY rn) AS context FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, user_id ORDER BY created_at DESC, obs_id) AS rn
  FROM kb_observations WHERE tier = 'episodic') WHERE rn <= 5 GROUP BY 1, 2""")
def _(kb):
    return mem.recent_context(kb.observations)


@query("gov01_newest_audit", """
SELECT tenant_id, seq, action, target, rank FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id ORDER BY ts DESC, seq DESC) AS rank FROM kb_audit) WHERE rank <= 50""")
def _(kb):
    return gov.newest_per_tenant(kb.audit).select("tenant_id", "seq", "action", "target", "rank")


def tenants(kb):
    """Tenants with more than a quarter of the documents' text are suspended."""
    n = kb.documents.groupBy("tenant_id").agg(F.sum("n_chars").alias("size"))
    total = kb.documents.agg(F.sum("n_chars").alias("total"))
    return n.join(F.broadcast(total)).select("tenant_id", F.when(  # one row
        F.col("size") * 4 > F.col("total"), "suspended").otherwise("active").alias("status"))


TENANTS = """tn AS (SELECT tenant_id, CASE WHEN sum(n_chars) * 4 > (SELECT sum(n_chars) FROM kb_documents) THEN 'suspended' ELSE 'active' END AS status
  FROM kb_documents GROUP BY 1)"""


@query("gov02_active_tenants", "WITH " + TENANTS + """
SELECT tenant_id, span_id FROM kb_spans SEMI JOIN (SELECT * FROM tn WHERE status = 'active') USING (tenant_id)""")
def _(kb):
    return gov.only_active(kb.spans, tenants(kb)).select("tenant_id", "span_id")


def wandering_citations(kb):
    """Citations filed under the tenant of the session's turn instead of the document's."""
    t = F.concat(F.lit("t"), ((F.col("conv_id") + F.col("turn")) % 4).cast("string"))
    return kb.answers.select(t.alias("tenant_id"), "answer_id",
                             F.concat(F.lit("sp_"), F.col("conv_id").cast("string"), F.lit("_1")).alias("span_id"))


@query("gov02_cross_tenant_probe", """
WITH c AS (SELECT 't' || ((conv_id + turn) % 4) AS tenant_id, answer_id, 'sp_' || conv_id || '_1' AS span_id FROM kb_answers)
SELECT c.tenant_id, c.answer_id, c.span_id, s.tenant_id AS owner_tenant FROM c JOIN kb_spans s ON s.span_id = c.span_id
WHERE s.tenant_id <> c.tenant_id""")
def _(kb):
    return gov.cross_tenant_leaks(wandering_citations(kb), kb.spans.select("tenant_id", "span_id"), "span_id").select(
        "tenant_id", "answer_id", "span_id", "owner_tenant")


@query("gov03_purge", "WITH " + TENANTS + """
SELECT tenant_id, fact_id FROM kb_facts ANTI JOIN (SELECT * FROM tn WHERE status = 'suspended') USING (tenant_id)""")
def _(kb):
    return gov.purge(kb.facts, tenants(kb).filter("status = 'suspended'")).select("tenant_id", "fact_id")


@query("gov03_purge_all_tables", "WITH " + TENANTS + """,
t AS (SELECT 'facts' AS name, tenant_id, count(*) AS n FROM kb_facts GROUP BY 2 UNION ALL
      SELECT 'spans', tenant_id, count(*) FROM kb_spans GROUP BY 2 UNION ALL SELECT 'turns', tenant_id, count(*) FROM kb_turns GROUP BY 2)
SELECT name, tenant_id, CASE WHEN status = 'suspended' THEN 0 ELSE n END AS n_left, CASE WHEN status = 'suspended' THEN n ELSE 0 END AS n_purged, status
FROM t JOIN tn USING (tenant_id)""")
def _(kb):
    root, tables = corpus.run_folder(kb.spark, "purge"), {"facts": kb.facts, "spans": kb.spans, "turns": kb.turns}
    for name, df in tables.items():
        corpus.write_by_tenant(df, f"{root}/{name}")
    who = tenants(kb)
    status, audit = gov.purge_tables(root, [*tables], who.withColumn("status", F.lit("active")), who.filter("status = 'suspended'"), 0.0)
    rows = None
    for name, df in tables.items():
        left = kb.spark.read.schema(df.schema).parquet(f"{root}/{name}").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_left"))
        part = status.select(F.lit(name).alias("name"), "tenant_id", "status").join(left, "tenant_id", "left")
        rows = part if rows is None else rows.unionByName(part)
    purged = audit.select("tenant_id", F.col("target").alias("name"), F.col("n_rows").alias("n_purged"))
    return rows.join(purged, ["tenant_id", "name"], "left").na.fill(0).filter("n_left + n_purged > 0")


@query("gov04_effective_settings", """
SELECT d.document_id, CAST(coalesce(s.lint_ambiguous_ratio, 0.15) AS DOUBLE) AS lint_ambiguous_ratio,
       CAST(coalesce(s.lint_hub_inferred_ratio, 0.20) AS DOUBLE) AS lint_hub_inferred_ratio,
       coalesce(s.summary_max_chars, 200) AS summary_max_chars, 'D1' AS default_depth
FROM kb_documents d LEFT JOIN kb_settings s USING (tenant_id)""")
def _(kb):
    return gov.effective_settings(kb.documents.select("tenant_id", "document_id"), kb.settings).select(
        "document_id", "lint_ambiguous_ratio", "lint_hub_inferred_ratio", "summary_max_chars", "default_depth")


def overrides(kb):
    """Setting overrides as events might carry them: a field by event type and its value."""
    field = F.when(F.col("event_type") == "click", "lint_ambiguous_ratio").when(
        F.col("event_type") == "view", "summary_max_chars").when(
        F.col("event_type") == "error", "lint_typo").otherwise("custom_rules")
    return kb.raw("events").select("event_id", field.alias("field"), F.when(
        F.col("event_type") == "view", F.col("props")).otherwise(F.col("value").cast("string")).alias("value"))


@query("gov04_rejected_settings", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'unknown_field' WHEN 'view' THEN 'not_a_number'
  ELSE 'out_of_range' END AS problem
FROM events WHERE event_type IN ('error', 'view') OR (event_type = 'click' AND (value < 0 OR value > 1))""")
def _(kb):
    return gov.validate_overrides(overrides(kb))[1].select("event_id", "problem")


@query("gov05_counters", """
SELECT tenant_id, action, count(*) AS total, round(sum(value), 4) AS amount FROM kb_audit GROUP BY 1, 2""")
def _(kb):
    calls = gov.counters(kb.audit, ["tenant_id", "action"])
    amount = gov.counters(kb.audit, ["tenant_id", "action"], "value").withColumnRenamed("total", "amount")
    return calls.join(amount, ["tenant_id", "action"]).withColumn("amount", R("amount", 4))


HIST = """
SELECT {keys}, le, count(*) FILTER (bound IS NULL OR v <= bound) AS bucket_count, count(*) AS "count", round(sum(v), 4) AS "sum"
FROM (SELECT *, value / 10 AS v FROM kb_audit), (VALUES ('0.1', 0.1), ('0.5', 0.5), ('1.0', 1.0), ('2.0', 2.0), ('5.0', 5.0),
  ('10.0', 10.0), ('30.0', 30.0), ('60.0', 60.0), ('+Inf', NULL)) b(le, bound) GROUP BY {keys}, le"""


@query("gov06_histogram", HIST.format(keys="tenant_id, action"))
def _(kb):
    return gov.histogram(kb.audit.withColumn("v", F.col("value") / 10), ["tenant_id", "action"], "v").withColumn(
        "sum", R("sum", 4))


@query("gov07_hit_ratio", """
SELECT tenant_id, count(*) FILTER (action = 'view') AS hits, count(*) AS calls,
       round(count(*) FILTER (action = 'view') / count(*), 6) AS hit_ratio FROM kb_audit GROUP BY 1""")
def _(kb):
    return gov.hit_ratio(kb.audit, ["tenant_id"], F.col("action") == "view").withColumn("hit_ratio", R("hit_ratio", 6))


@query("wik01_provenance_mix", """
SELECT tenant_id, entity_id, provenance, n, round(n / sum(n) OVER (PARTITION BY tenant_id, entity_id), 3) AS share
FROM (SELECT tenant_id, subject_entity AS entity_id, provenance, count(*) AS n FROM kb_facts GROUP BY 1, 2, 3)""")
def _(kb):
    return wiki.provenance_mix(kb.facts).drop("total")


@query("wik02_importance", """
SELECT tenant_id, entity_id, CASE WHEN degree >= 5 THEN 'core' WHEN degree >= 1 THEN 'supporting' ELSE 'peripheral' END AS tier
FROM kb_degrees""")
def _(kb):
    return kb.degrees.select("tenant_id", "entity_id", wiki.importance(F.col("degree")).alias("tier"))


PAGES_SQL = """
WITH f AS (SELECT tenant_id, entity_id, string_agg(line, chr(10) ORDER BY pos) AS block FROM (
  SELECT tenant_id, subject_entity AS entity_id, '- ' || subject_entity || ' ' || predicate || ' ' || object_value || ' [span:' ||
    coalesce(span_id, '') || ']' || CASE WHEN provenance = 'ambiguous' THEN ' !conflict' ELSE '' END AS line,
    row_number() OVER (PARTITION BY tenant_id, subject_entity ORDER BY fact_id) AS pos FROM kb_facts) WHERE pos <= 60 GROUP BY 1, 2),
r AS (SELECT tenant_id, entity_id, string_agg(line, chr(10) ORDER BY pos) AS block FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, entity_id ORDER BY relation_id) AS pos FROM (
    SELECT tenant_id, relation_id, '- ' || source_entity || ' ' || relation_type || ' ' || target_entity AS line,
           unnest([source_entity, target_entity]) AS entity_id FROM kb_edges)) WHERE pos <= 30 GROUP BY 1, 2)
SELECT e.tenant_id, e.entity_id, e.name || ' (' || e.type || ')' || chr(10) || chr(10) || coalesce(f.block, '') ||
  chr(10) || chr(10) || coalesce(r.block, '') AS content
FROM kb_entities e LEFT JOIN f USING (tenant_id, entity_id) LEFT JOIN r USING (tenant_id, entity_id)"""


def pages(kb):
    return wiki.page_sources(kb.entities, kb.facts, kb.edges)


def fact_spans(kb):
    """Link rows: the own span of a fact, and for extracted facts one or two more."""
    more = F.when(F.col("provenance") == "extracted", F.when(F.col("source_count") >= 3, F.array(F.lit("c"), F.lit("b"))).otherwise(F.array(F.lit("b"))))
    ends = F.concat(F.array(F.lit("")), F.coalesce(more, F.array().cast("array<string>")))
    return kb.facts.filter("span_id IS NOT NULL").select("tenant_id", "fact_id", "span_id", F.posexplode(ends).alias("pos", "end")).select(
        "tenant_id", "fact_id", F.concat("span_id", "end").alias("span_id"), "pos")


@query("wik03_pages_with_two_spans", PAGES_SQL.replace("coalesce(span_id, '')", """coalesce(span_id || CASE
    WHEN provenance = 'extracted' AND source_count >= 3 THEN ',' || span_id || 'c'
    WHEN provenance = 'extracted' THEN ',' || span_id || 'b' ELSE '' END, '')"""))
def _(kb):
    return wiki.page_sources(kb.entities, kb.facts, kb.edges, fact_spans(kb)).select("tenant_id", "entity_id", "content")


@query("wik03_page_entities", """
SELECT tenant_id, document_id, entity_id, pos FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, document_id ORDER BY entity_id) AS pos FROM (
    SELECT DISTINCT e.tenant_id, d.source_uri AS document_id, e.entity_id FROM kb_entities e JOIN kb_documents d USING (tenant_id, document_id)))
WHERE pos <= 50""")
def _(kb):
    """Sources as documents of many entities, so that the bound of pages per document shows."""
    of = kb.entities.select("tenant_id", "entity_id", "document_id").join(kb.documents.select("tenant_id", "document_id", "source_uri"), ["tenant_id", "document_id"])
    return wiki.page_entities(of.select("tenant_id", F.col("source_uri").alias("document_id"), "entity_id"))


@query("wik03_page_sources", PAGES_SQL)
def _(kb):
    return pages(kb).select("tenant_id", "entity_id", "content")


def nodes(kb):
    return kb.entities.select("tenant_id", F.concat(F.lit("wk_"), "entity_id").alias("node_id"), F.col("name").alias("title"),
                              "entity_id", F.lit("core").alias("tier"), F.col("type").alias("content"))


@query("wik04_upsert_pages", """
SELECT tenant_id, 'wk_' || entity_id AS node_id, CASE WHEN type IN ('product', 'org') THEN name ELSE 'new ' || name END AS title,
       entity_id, CASE WHEN type IN ('product', 'org') THEN 'core' ELSE 'supporting' END AS tier,
       CASE WHEN type = 'product' THEN type ELSE 'v2 ' || type END AS content,
       CASE WHEN type = 'product' THEN '{}' ELSE mix END AS provenance_mix
FROM kb_entities LEFT JOIN (
  SELECT tenant_id, entity_id, '{' || string_agg('"' || provenance || '":' || CASE WHEN share = 1 THEN '1.0' ELSE CAST(CAST(share AS DOUBLE) AS VARCHAR) END,
                                                 ',' ORDER BY provenance) || '}' AS mix FROM (
    SELECT tenant_id, entity_id, provenance, round(n / sum(n) OVER (PARTITION BY tenant_id, entity_id), 3) AS share
    FROM (SELECT tenant_id, subject_entity AS entity_id, provenance, count(*) AS n FROM kb_facts GROUP BY 1, 2, 3)) GROUP BY 1, 2)
USING (tenant_id, entity_id)""")
def _(kb):
    n = nodes(kb).withColumn("provenance_mix", F.lit("{}"))
    fresh = n.filter("content <> 'product'").withColumns({
        "title": F.concat(F.lit("new "), "title"), "tier": F.lit("supporting"), "content": F.concat(F.lit("v2 "), "content")}).drop("provenance_mix").join(
        wiki.mix_column(kb.facts), ["tenant_id", "entity_id"], "left")
    return wiki.upsert_pages(n.filter("content in ('product', 'org')"), fresh)


@query("wik05_previews", """
WITH p AS (SELECT document_id, count(*) AS n, string_agg(title, chr(10) ORDER BY pos) AS b FROM (
  SELECT document_id, name AS title, row_number() OVER (PARTITION BY tenant_id, document_id ORDER BY name, 'wk_' || entity_id) AS pos FROM kb_entities)
  WHERE pos <= 50 GROUP BY 1),
f AS (SELECT document_id, count(*) AS n, string_agg(fact_id, chr(10) ORDER BY fact_id) AS b FROM (
  SELECT document_id, fact_id, row_number() OVER (PARTITION BY tenant_id, document_id ORDER BY fact_id) AS pos FROM kb_facts) WHERE pos <= 100 GROUP BY 1)
SELECT d.tenant_id, d.document_id, coalesce(p.n, 0) AS n_pages, coalesce(p.b, '') AS pages, 1 AS n_sections, c.summary AS sections,
       coalesce(f.n, 0) AS n_facts, coalesce(f.b, '') AS facts, CASE WHEN p.n > 0 THEN 'wiki_nodes' ELSE 'draft_summary' END AS mode
FROM kb_documents d LEFT JOIN p USING (document_id) LEFT JOIN f USING (document_id) JOIN kb_chunks c USING (document_id)""")
def _(kb):
    links = kb.entities.select("tenant_id", "entity_id", "document_id")
    return wiki.previews(kb.documents, nodes(kb), links, kb.chunks, kb.facts).select(
        "tenant_id", "document_id", "n_pages", "pages", "n_sections", "sections", "n_facts", "facts", "mode")


def digests(kb):
    """Model digests of each answer: one good fact, one without an object, and a title."""
    return kb.answers.select(
        "tenant_id", "answer_id", F.lit("why").alias("question"), "answer",
        F.when(F.col("turn") % 3 == 0, F.lit(None).cast("double")).otherwise(F.col("turn") % 10 / 10.0).alias("verified_ratio"),
        F.when(F.col("conv_id") % 10 == 9, "no digest").otherwise(F.concat(
            F.lit('```json\n{"title":"T '), "answer_id", F.lit('","digest":"D","facts":[{"subject":"s_'), "answer_id",
            F.lit('","predicate":"p","object":"o","source_span_ids":["sp_1"]},{"subject":"x","predicate":"p","object":""}]}\n```')
        )).alias("response"))


GOOD = """(SELECT * FROM kb_answers WHERE conv_id % 10 <> 9 AND (turn % 3 = 0 OR turn % 10 / 10.0 >= 0.6))"""


@query("wik06_crystallized_facts", f"""
SELECT tenant_id, answer_id, 's_' || answer_id AS subject_entity, 'p' AS predicate, 'o' AS object_value, 'inferred' AS provenance,
       sha256('why' || answer || chr(0) || 'crystallize' || chr(0)) AS source_hash FROM {GOOD}""")
def _(kb):
    return wiki.crystallize(digests(kb))[1].select(
        "tenant_id", "answer_id", "subject_entity", "predicate", "object_value", "provenance", "source_hash")


@query("wik06_crystallized_pages", f"""
SELECT tenant_id, 'T ' || answer_id AS title, 'D' AS content, 'supporting' AS tier FROM {GOOD}""")
def _(kb):
    return wiki.crystallize(digests(kb))[0].select("tenant_id", "title", "content", "tier")


@query("wik07_quality", """
SELECT answer_id, greatest(0.0, (10 - s - c - e) / 10.0) AS score, s + c + e <= 4 AS passed,
       concat_ws(',', CASE WHEN s > 0 THEN 'too_short' END, CASE WHEN c > 0 THEN 'no_citation' END,
                 CASE WHEN e > 0 THEN 'no_sentence_boundary' END) AS flags
FROM (SELECT answer_id, CASE WHEN length(trim(answer, ' ' || chr(10))) < 20 THEN 4 ELSE 0 END AS s,
  CASE WHEN regexp_matches(answer, '\\[[\\w\\-]+:[\\w\\-]+\\]') THEN 0 ELSE 4 END AS c,
  CASE WHEN regexp_matches(answer, '[。.!?！？]') THEN 0 ELSE 1 END AS e FROM kb_answers)""")
def _(kb):
    score, flags, ok = wiki.quality("answer")
    return kb.answers.select("answer_id", score.alias("score"), ok.alias("passed"), F.array_join(flags, ",").alias("flags"))


def model_answers(kb):
    """Extraction answers in all the shapes a model produces, chosen by the source of the document.

    src0 strict, src1 fenced, src2 with words around it, src3 with trailing commas, src4 unreadable.
    """
    d = F.col("doc_id").cast("string")
    tail = F.when(F.col("source_uri") == "src3", ",").otherwise("")
    body = F.concat(
        F.lit('{"facts":[{"subject":"part_'), d, F.lit('","predicate":"in","object":"'), "source_uri",
        F.lit('","qualifiers":{"unit":"x"},"source_span_index":[0,5,99]}'), tail,
        F.lit('],"entities":[{"name":"E'), d, F.lit('","span_index":[0]},{"name":"","type":"org"},{"name":"F","type":"org"}'),
        tail, F.lit("]}"))
    src = F.col("source_uri")
    text = F.when(src == "src1", F.concat(F.lit("```json\n"), body, F.lit("\n```"))) \
        .when(src == "src2", F.concat(F.lit("Here it is: "), body, F.lit(" done"))) \
        .when(src == "src4", F.lit("no facts {")).otherwise(body)
    return kb.documents.select("tenant_id", "document_id", F.concat(F.lit("ch_"), d).alias("chunk_id"), "source_uri",
                               text.alias("response"))


@query("ext01_requests", """
SELECT tenant_id, document_id, chunk_id AS custom_id,
       'spans:' || chr(10) || string_agg('[' || (span_no - 1) || '] ' || content, chr(10) ORDER BY span_no) AS user_text
FROM kb_spans GROUP BY 1, 2, 3""")
def _(kb):
    types = kb.settings.select("tenant_id", F.lit("org/place").alias("entity_types"), F.lit("Be brief.").alias("custom_rules"))
    return ext.requests(kb.spans, types).select("tenant_id", "document_id", "custom_id", "user_text")


@query("ext02_parse_responses", """
SELECT document_id, source_uri <> 'src4' AS readable, CASE WHEN source_uri <> 'src4' THEN 1 END AS n_facts,
       CASE WHEN source_uri <> 'src4' THEN 3 END AS n_entities FROM kb_documents""")
def _(kb):
    return ext.parsed(model_answers(kb)).select(
        "document_id", F.col("r").isNotNull().alias("readable"),
        F.when(F.col("r").isNotNull(), F.size("r.facts")).alias("n_facts"),
        F.when(F.col("r").isNotNull(), F.size("r.entities")).alias("n_entities"))


@query("ext03_facts", """
SELECT d.tenant_id, d.document_id, 'part_' || d.doc_id AS subject_entity, 'in' AS predicate, d.source_uri AS object_value,
       'sp_' || d.doc_id || '_1' || CASE WHEN n >= 6 THEN ',sp_' || d.doc_id || '_6' ELSE '' END ||
       CASE WHEN n >= 100 THEN ',sp_' || d.doc_id || '_100' ELSE '' END AS spans
FROM kb_documents d JOIN (SELECT document_id, count(*) AS n FROM kb_spans GROUP BY 1) USING (document_id) WHERE source_uri <> 'src4'""")
def _(kb):
    return ext.facts_of(model_answers(kb), kb.spans).select(
        "tenant_id", "document_id", "subject_entity", "predicate", "object_value", F.array_join("source_span_ids", ",").alias("spans"))


@query("ext04_entities", """
SELECT tenant_id, document_id, 'E' || doc_id AS name, 'concept' AS type, 'sp_' || doc_id || '_1' AS spans FROM kb_documents WHERE source_uri <> 'src4'
UNION ALL SELECT tenant_id, document_id, 'F', 'org', '' FROM kb_documents WHERE source_uri <> 'src4'""")
def _(kb):
    return ext.entities_of(model_answers(kb), kb.spans).select(
        "tenant_id", "document_id", "name", "type", F.array_join("mention_span_ids", ",").alias("spans"))


RULES = [(r"([a-z]{4,10}) the ([a-z]{4,10})", "the", "", "thing", None),
         (r"([a-z]{4,10}) is ([a-z]{4,10})", "is", "!", "thing", "value")]


@query("ext05_rule_matches", """
SELECT document_id, s AS subject, 'the' AS predicate, o AS object FROM (SELECT document_id,
  unnest(regexp_extract_all(content, '([a-z]{4,10}) the ([a-z]{4,10})', 1)) AS s,
  unnest(regexp_extract_all(content, '([a-z]{4,10}) the ([a-z]{4,10})', 2)) AS o FROM kb_documents)
UNION ALL SELECT document_id, s, 'is', o || '!' FROM (SELECT document_id,
  unnest(regexp_extract_all(content, '([a-z]{4,10}) is ([a-z]{4,10})', 1)) AS s,
  unnest(regexp_extract_all(content, '([a-z]{4,10}) is ([a-z]{4,10})', 2)) AS o FROM kb_documents)""")
def _(kb):
    return ext.rule_matches(kb.documents.select("document_id", "content"), RULES).select(
        "document_id", "subject", "predicate", "object")


@query("ext06_join_batch", """
SELECT tenant_id, 'ch_' || (c.doc_id // 4) AS custom_id,
       CASE WHEN m.quality = 1 THEN 'ok ' || c.chunk_id ELSE '{"facts":[],"entities":[]}' END AS response
FROM kb_chunks c LEFT JOIN labels m USING (doc_id)""")
def _(kb):
    # The same ids in all tenants, and every answer twice.
    key = F.concat(F.lit("ch_"), F.floor(F.col("doc_id") / 4).cast("string")).alias("custom_id")
    tenant = F.concat(F.lit("t"), (F.col("doc_id") % 4).cast("string")).alias("tenant_id")
    results = kb.raw("labels").select(tenant, key, F.when(F.col("quality") == 1, "succeeded").otherwise("errored").alias("type"),
                                      F.concat(F.lit("ok ch_"), F.col("doc_id").cast("string")).alias("text"))
    return ext.join_batch(kb.chunks.select("tenant_id", key), results.unionByName(results))


@query("ext07_relation_answers", """
SELECT 't' || (l_partkey % 4) AS tenant_id, 'doc_' || l_partkey AS document_id, 'S' || l_suppkey AS source,
       CASE WHEN l_linestatus = 'O' THEN 'owns' END AS relation_type, 'P' || l_partkey AS target,
       'sp_' || l_partkey || '_' || (l_linenumber % 3) AS source_span_ids FROM lineitem WHERE l_partkey % 5 <> 0""")
def _(kb):
    p = F.col("l_partkey").cast("string")
    one = F.struct(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source"),
                   F.when(F.col("l_linestatus") == "O", "owns").alias("relation_type"), F.concat(F.lit("P"), p).alias("target"),
                   F.array((F.col("l_linenumber") % 3).cast("int"), F.lit(99), F.lit(-1)).alias("source_span_index"))
    # One answer per part, fenced as models do; those of every fifth part are cut off.
    answers = (kb.raw("lineitem").groupBy("l_partkey").agg(F.to_json(F.struct(F.collect_list(one).alias("relations"))).alias("j"))
               .select(F.concat(F.lit("t"), (F.col("l_partkey") % 4).cast("string")).alias("tenant_id"),
                       F.concat(F.lit("doc_"), p).alias("document_id"),
                       F.when(F.col("l_partkey") % 5 == 0, F.expr("left(j, length(j) - 2)"))
                        .otherwise(F.concat(F.lit("```json\n"), "j", F.lit("\n```"))).alias("response"),
                       F.array(*[F.concat(F.lit("sp_"), p, F.lit(f"_{i}")) for i in range(3)]).alias("span_ids")))
    return ext.parse_relations(answers).withColumn("source_span_ids", F.array_join("source_span_ids", ","))


@query("ext07_relations", """
WITH i AS (SELECT tenant_id, lower(name) AS k, min(entity_id) AS id FROM kb_entities GROUP BY 1, 2),
a AS (SELECT DISTINCT 't' || (l_partkey % 4) AS tenant_id, s_name, p_name, l_linestatus FROM lineitem
      JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
SELECT a.tenant_id, s.id AS source_entity, CASE WHEN l_linestatus = 'O' THEN 'depends_on' ELSE 'related_to' END AS relation_type,
       p.id AS target_entity, 'rl_' || left(sha256(a.tenant_id || ':' || s.id || ':' ||
         CASE WHEN l_linestatus = 'O' THEN 'depends_on' ELSE 'related_to' END || ':' || p.id), 16) AS relation_id
FROM a JOIN i s ON s.tenant_id = a.tenant_id AND s.k = lower(a.s_name) JOIN i p ON p.tenant_id = a.tenant_id AND p.k = lower(a.p_name)""")
def _(kb):
    li = kb.raw("lineitem")
    named = li.join(kb.raw("supplier"), li["l_suppkey"] == F.col("s_suppkey")).join(
        kb.raw("part"), li["l_partkey"] == F.col("p_partkey"))
    answers = named.select(
        F.concat(F.lit("t"), (F.col("l_partkey") % 4).cast("string")).alias("tenant_id"), F.upper("s_name").alias("source"),
        F.when(F.col("l_linestatus") == "O", "Depends On").otherwise("???").alias("relation_type"),
        F.col("p_name").alias("target")).distinct()
    unknown = answers.withColumn("target", F.lit("nobody"))
    loops = answers.withColumn("target", F.col("source"))
    return ext.relations_of(answers.unionByName(unknown).unionByName(loops), kb.entities).select(
        "tenant_id", "source_entity", "relation_type", "target_entity", "relation_id")


@query("ext08_provenance", """
SELECT fact_id, CASE WHEN provenance = 'ambiguous' THEN 'ambiguous' WHEN span_id IS NOT NULL THEN 'extracted' ELSE 'inferred' END AS provenance
FROM kb_facts""")
def _(kb):
    f = kb.facts.withColumn("provenance", F.when(F.col("provenance") == "ambiguous", "ambiguous"))
    return ext.provenance_rule(f, F.col("span_id").isNotNull()).select("fact_id", "provenance")


@query("ext09_repoint", """
WITH i AS (SELECT tenant_id, lower(name) AS k, min(entity_id) AS id FROM kb_entities GROUP BY 1, 2),
f AS (SELECT 't' || (l_partkey % 4) AS tenant_id, p_name AS s, 'SUPPLIER#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') AS o, l_orderkey, l_linenumber
      FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT f.tenant_id, l_orderkey, l_linenumber, coalesce(a.id, s) AS subject_entity, coalesce(b.id, o) AS object_value
FROM f LEFT JOIN i a ON a.tenant_id = f.tenant_id AND a.k = lower(s) LEFT JOIN i b ON b.tenant_id = f.tenant_id AND b.k = lower(o)""")
def _(kb):
    li = kb.raw("lineitem")
    rows = li.join(kb.raw("part"), li["l_partkey"] == F.col("p_partkey")).select(
        F.concat(F.lit("t"), (F.col("l_partkey") % 4).cast("string")).alias("tenant_id"), F.col("p_name").alias("subject_entity"),
        F.concat(F.lit("SUPPLIER#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")).alias("object_value"),
        "l_orderkey", "l_linenumber")
    return ext.repoint(rows, ext.name_index(kb.entities)).select(
        "tenant_id", "l_orderkey", "l_linenumber", "subject_entity", "object_value")
