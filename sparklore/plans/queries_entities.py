"""Entity resolution queries."""

from pyspark.sql import functions as F

from sparklore.functions import text as tx
from sparklore.operators import entities as ent
from sparklore.plans.fixture_sql import BLOCK_SQL
from sparklore.plans.registry import query

R = F.round


@query("ent01_block_key", f"SELECT tenant_id, entity_id, {BLOCK_SQL} AS name_block FROM kb_entities")
def _(kb):
    return ent.with_block(kb.entities).select("tenant_id", "entity_id", "name_block")


@query("ent02_block_candidates", """
SELECT n.tenant_id, n.name_block, n.entity_id, coalesce(c.n, 0) AS candidates FROM kb_incoming n
LEFT JOIN (SELECT tenant_id, name_block, count(*) AS n FROM kb_known GROUP BY 1, 2) c USING (tenant_id, name_block)""")
def _(kb):
    return ent.block_candidates(kb.new_entities, kb.entities)


@query("ent03_exact_match", """
SELECT n.tenant_id, n.entity_id, min(e.entity_id) AS canonical_id FROM kb_incoming n
JOIN kb_known e USING (tenant_id, name_block, name_key) GROUP BY 1, 2""")
def _(kb):
    return ent.exact_matches(kb.new_entities, kb.entities)


@query("ent04_alias_match", """
SELECT n.tenant_id, n.entity_id, min(e.entity_id) AS canonical_id FROM kb_incoming n
JOIN (SELECT tenant_id, name_block, entity_id, lower(unnest(aliases)) AS name_key FROM kb_known) e
  USING (tenant_id, name_block, name_key) GROUP BY 1, 2""")
def _(kb):
    return ent.alias_matches(kb.new_entities, kb.entities)


@query("ent05_fuzzy_match")
def _(kb):
    return ent.fuzzy_matches(kb.new_entities, kb.entities)


@query("ent05_fuzzy_match_customers")
def _(kb):
    people = kb.entities.filter("type = 'person'")
    return ent.fuzzy_matches(people, people)


@query("ent06_embedding_match", """
SELECT tenant_id, entity_id, canonical_id, round(sim, 6) AS sim, CAST(rank AS INTEGER) AS rank FROM kb_close""")
def _(kb):
    return ent.embedding_matches(kb.new_entities, kb.entities).withColumn("sim", R("sim", 6))


@query("ent07_merge_requests", """
SELECT c.tenant_id, c.entity_id, c.canonical_id, v.k % 2 >= 0 AND v.p_size % 2 = 1 AS merge,
       '{"a":{"name":"' || v.name || '","type":"product"},"b":{"name":"' || e.name || '","aliases":["' || e.aliases[1] || '"]}}' AS request
FROM kb_close c JOIN kb_new v USING (tenant_id, entity_id)
JOIN kb_entities e ON e.tenant_id = c.tenant_id AND e.entity_id = c.canonical_id""")
def _(kb):
    pairs = ent.embedding_matches(kb.new_entities, kb.entities)
    req = ent.merge_requests(pairs, kb.new_entities, kb.entities)
    return req.join(kb.merge_verdicts, ["tenant_id", "entity_id", "canonical_id"], "left").select(
        "tenant_id", "entity_id", "canonical_id", "request", F.coalesce("merge", F.lit(False)).alias("merge"))


@query("ent08_resolve", """
WITH hits AS (
  SELECT n.entity_id, 1 AS tier, 0 AS ord, min(e.entity_id) AS canonical_id FROM kb_incoming n
  JOIN kb_known e USING (tenant_id, name_block, name_key) GROUP BY 1
  UNION ALL
  SELECT n.entity_id, 2, 0, min(e.entity_id) FROM kb_incoming n
  JOIN (SELECT tenant_id, name_block, entity_id, lower(unnest(aliases)) AS name_key FROM kb_known) e
    USING (tenant_id, name_block, name_key) GROUP BY 1
  UNION ALL
  SELECT c.entity_id, 3, c.rank, c.canonical_id FROM kb_close c JOIN kb_new n USING (tenant_id, entity_id)
  WHERE n.p_size % 2 = 1 AND c.canonical_id = 'part_' || n.k),
best AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY tier, ord, canonical_id) AS rn FROM hits)
SELECT n.tenant_id, n.entity_id, coalesce(b.canonical_id, n.entity_id) AS canonical_id, coalesce(b.tier, 4) AS tier
FROM kb_new n LEFT JOIN best b ON b.entity_id = n.entity_id AND b.rn = 1""")
def _(kb):
    return ent.resolve(kb.new_entities, kb.entities, kb.merge_verdicts, fuzzy=False)


@query("ent08_resolve_fuzzy")
def _(kb):
    return ent.resolve(kb.new_entities, kb.entities, kb.merge_verdicts)


@query("ent09_self_merge", """
SELECT tenant_id, entity_id, min(entity_id) OVER (PARTITION BY tenant_id, name_block, name_key) AS canonical_id FROM kb_incoming""")
def _(kb):
    return ent.self_merge(kb.new_entities)


@query("ent09_self_merge_fuzzy")
def _(kb):
    return ent.self_merge(kb.new_entities, fuzzy=True)


def described(kb):
    """Known parts with or without a text, and arriving descriptions from order lines."""
    p = F.col("p_partkey")
    tenant = F.concat(F.lit("t"), (p % 4).cast("string"))
    base = kb.raw("part").select(tenant.alias("tenant_id"), tx.cat("part_", p).alias("entity_id"), F.col("p_name").alias("name"),
                                 F.lit("product").alias("type"),
                                 F.when(F.col("p_size") > 25, "").otherwise(F.col("p_brand")).alias("description"))
    lines = kb.sightings.filter("relation_type <> 'belongs_to'")
    both = F.explode(F.array("source_entity", "target_entity"))
    arrivals = lines.select("tenant_id", both.alias("entity_id"), "seq", "relation_type").select(
        "tenant_id", "entity_id", "seq", F.lit("unnamed").alias("name"), F.lit("thing").alias("type"),
        F.when(F.col("relation_type") == "owns", F.concat(F.lit("seen in "), "seq")).otherwise("").alias("description"))
    return base, arrivals


@query("ent10_upsert_entities", """
WITH a AS (SELECT tenant_id, unnest([source_entity, target_entity]) AS entity_id, seq,
                  CASE WHEN relation_type = 'owns' THEN 'seen in ' || seq ELSE '' END AS description
           FROM kb_sightings WHERE relation_type <> 'belongs_to'),
g AS (SELECT tenant_id, entity_id, arg_max(description, seq) FILTER (description <> '') AS d FROM a GROUP BY 1, 2),
b AS (SELECT 't' || (p_partkey % 4) AS tenant_id, 'part_' || p_partkey AS entity_id, p_name AS name,
             CASE WHEN p_size > 25 THEN '' ELSE p_brand END AS description FROM part)
SELECT tenant_id, entity_id, coalesce(b.name, 'unnamed') AS name, CASE WHEN b.name IS NULL THEN 'thing' ELSE 'product' END AS type,
       coalesce(g.d, b.description, '') AS description FROM b FULL JOIN g USING (tenant_id, entity_id)""")
def _(kb):
    return ent.upsert_entities(*described(kb))


@query("ent10_entity_links", """
SELECT tenant_id, entity_id, 'alias' AS kind, unnest(aliases) AS value FROM kb_entities
UNION SELECT tenant_id, entity_id, 'mention', mention_span_id FROM kb_entities
UNION SELECT tenant_id, entity_id, 'document', document_id FROM kb_entities
UNION SELECT tenant_id, target_entity, 'mention', span_id FROM kb_sightings""")
def _(kb):
    e = kb.entities
    return ent.entity_links(
        e.select("tenant_id", "entity_id", F.lit("alias").alias("kind"), F.explode("aliases").alias("value")),
        e.select("tenant_id", "entity_id", F.lit("mention").alias("kind"), F.col("mention_span_id").alias("value")),
        e.select("tenant_id", "entity_id", F.lit("document").alias("kind"), F.col("document_id").alias("value")),
        kb.sightings.select("tenant_id", F.col("target_entity").alias("entity_id"), F.lit("mention").alias("kind"),
                            F.col("span_id").alias("value")))


@query("ent11_lookup", """
SELECT 'n_' || n.entity_id AS request_id, n.tenant_id, min(e.entity_id) AS entity_id FROM kb_new n
JOIN kb_known e ON e.tenant_id = n.tenant_id AND e.name_key = lower(n.name) GROUP BY n.entity_id, n.tenant_id
UNION ALL
SELECT 'i_' || n.entity_id, n.tenant_id, 'part_' || n.k FROM kb_new n""")
def _(kb):
    n = kb.new_entities
    by_name = n.select(F.concat(F.lit("n_"), "entity_id").alias("request_id"), "tenant_id",
                       F.lit(None).cast("string").alias("entity_id"), "name")
    by_id = n.select(F.concat(F.lit("i_"), "entity_id").alias("request_id"), "tenant_id",
                     F.regexp_replace("entity_id", "^new_", "part_").alias("entity_id"),
                     F.lit(None).cast("string").alias("name"))
    return ent.lookup(by_name.unionByName(by_id), kb.entities).select("request_id", "tenant_id", "entity_id")


def brand_hints(kb):
    """One vector question per label, with each part name as its hint."""
    names = kb.raw("part").select(F.split("p_name", " ")[1].alias("question")).distinct()
    tenants = kb.entities.select("tenant_id").distinct()
    return (kb.query_vectors.join(names.join(tenants))
            .select("tenant_id", "question", "vector",
                    F.concat("tenant_id", F.lit("_"), "question", F.lit("_"), F.col("label").cast("string")).alias("qid")))


@query("ent12_link_entities", """
WITH q AS (SELECT t.tenant_id, w.question, v.vector, t.tenant_id || '_' || w.question || '_' || v.label AS qid
           FROM kb_query_vectors v, (SELECT DISTINCT split_part(p_name, ' ', 2) AS question FROM part) w,
                (SELECT DISTINCT tenant_id FROM kb_entities) t),
near AS (SELECT * FROM (SELECT q.qid, q.tenant_id, e.entity_id, list_cosine_similarity(q.vector, e.embedding) AS sim,
           row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(q.vector, e.embedding), 9) DESC, e.entity_id) AS rn
         FROM q JOIN kb_known e ON e.tenant_id = q.tenant_id AND e.embedding IS NOT NULL) WHERE rn <= 5),
named AS (SELECT * FROM (SELECT q.qid, q.tenant_id, e.entity_id,
           row_number() OVER (PARTITION BY q.qid ORDER BY e.entity_id) AS rn
         FROM q JOIN kb_known e ON e.tenant_id = q.tenant_id AND contains(e.name_key, lower(q.question))) WHERE rn <= 5)
SELECT tenant_id, qid, entity_id, round(sim, 6) AS sim FROM near
UNION ALL SELECT n.tenant_id, n.qid, n.entity_id, 1.0 FROM named n ANTI JOIN near r ON r.qid = n.qid AND r.entity_id = n.entity_id""")
def _(kb):
    return ent.link_entities(brand_hints(kb), kb.entities).withColumn("sim", R("sim", 6))
