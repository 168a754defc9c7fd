"""Typed graph queries."""

from pyspark.sql import functions as F

from sparklore.functions.relations import RELATION_ALIASES, RELATION_SPECS, RELATION_TYPES, normalize_relation
from sparklore.operators import graph
from sparklore.plans.registry import query

R = F.round


def spelled(kb):
    """Raw relation names as a model might write them, built from the event and line data."""
    by_type = kb.raw("events").select(
        F.concat_ws("-", F.lit("Depends"), F.lit("on")).alias("a"), "event_type", "event_id")
    return by_type.select("event_id", F.when(F.col("event_type") == "click", "used-by")
                          .when(F.col("event_type") == "view", "  Depends   On ")
                          .when(F.col("event_type") == "error", "Caused by!")
                          .when(F.col("event_type") == "purchase", "supersedes")
                          .otherwise(F.concat(F.lit("x "), F.col("event_type"))).alias("raw"))


_ALIAS_SQL = "CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RELATION_ALIASES.items()) \
    + " ELSE replace(c, ' ', '_') END"
SPELLED_SQL = """SELECT event_id, CASE event_type WHEN 'click' THEN 'used-by' WHEN 'view' THEN '  Depends   On '
  WHEN 'error' THEN 'Caused by!' WHEN 'purchase' THEN 'supersedes' ELSE 'x ' || event_type END AS raw FROM events"""
_TYPES = ", ".join(f"'{t}'" for t in RELATION_TYPES)


@query("grf01_normalize_relation", f"""
WITH s AS ({SPELLED_SQL}),
c AS (SELECT event_id, raw, regexp_replace(replace(lower(trim(raw)), '-', '_'), '\\s+', ' ', 'g') AS c FROM s),
n AS (SELECT *, regexp_replace({_ALIAS_SQL}, '[^a-z0-9_]', '', 'g') AS t FROM c)
SELECT event_id, raw, CASE WHEN t IN ({_TYPES}) THEN t ELSE 'related_to' END AS strict,
       regexp_replace(lower(raw), '[\\s-]+', '_', 'g') AS tolerant FROM n""")
def _(kb):
    return spelled(kb).select("event_id", "raw", normalize_relation(F.col("raw")).alias("strict"),
                              normalize_relation(F.col("raw"), "tolerant").alias("tolerant"))


_SPEC_ROWS = ", ".join("('%s', %s, %s, %s)" % (n, f"'{i}'" if i else "NULL", str(a).lower(), str(s).lower())
                       for n, i, a, s in RELATION_SPECS)


@query("grf02_relation_attributes", f"""
SELECT relation_id, relation_type, inverse, acyclic, "symmetric" FROM kb_edges
JOIN (VALUES {_SPEC_ROWS}) s(relation_type, inverse, acyclic, "symmetric") USING (relation_type)""")
def _(kb):
    return graph.with_attributes(kb.edges).select("relation_id", "relation_type", "inverse", "acyclic", "symmetric")


EARLY = "seen_at < 883612800"


@query("grf03_relation_upsert", """
SELECT relation_id, tenant_id, source_entity, relation_type, target_entity, source_count,
       round(confidence, 6) AS confidence FROM kb_edges""")
def _(kb):
    s = graph.normalize_sightings(kb.sightings)
    merged = graph.merge_sightings(s.filter(f"NOT {EARLY}"), graph.merge_sightings(s.filter(EARLY)))
    return merged.select("relation_id", "tenant_id", "source_entity", "relation_type", "target_entity",
                         "source_count", R("confidence", 6).alias("confidence"))


@query("grf03_relation_spans", """
SELECT tenant_id, 'rl_' || left(sha256(tenant_id || ':' || source_entity || ':' || relation_type || ':' || target_entity), 16)
  AS relation_id, span_id, min(seq) AS first_seq
FROM kb_sightings GROUP BY tenant_id, source_entity, relation_type, target_entity, span_id""")
def _(kb):
    return kb.edge_spans


@query("grf04_degree", "SELECT tenant_id, entity_id, degree FROM kb_degrees")
def _(kb):
    return kb.degrees.select("tenant_id", "entity_id", "degree")


def seeds(kb):
    """The busiest supplier of each tenant."""
    return graph.filter_nodes(kb.degrees, type_filter="org", top_n=1).select("tenant_id", "entity_id")


SEEDS = """seed AS (SELECT tenant_id, entity_id FROM (SELECT *, row_number() OVER (
  PARTITION BY tenant_id ORDER BY degree DESC, entity_id) AS rn FROM kb_degrees WHERE type = 'org') WHERE rn = 1),
both_ways AS (SELECT relation_id, tenant_id, source_entity AS a, target_entity AS b FROM kb_edges
              UNION ALL SELECT relation_id, tenant_id, target_entity, source_entity FROM kb_edges)"""
WALK = SEEDS + """,
hop1 AS (SELECT DISTINCT w.tenant_id, w.b AS entity_id FROM both_ways w JOIN seed s ON s.tenant_id = w.tenant_id AND s.entity_id = w.a
         EXCEPT SELECT tenant_id, entity_id FROM seed),
hop2 AS (SELECT DISTINCT w.tenant_id, w.b AS entity_id FROM both_ways w JOIN hop1 s ON s.tenant_id = w.tenant_id AND s.entity_id = w.a
         EXCEPT SELECT * FROM hop1 EXCEPT SELECT tenant_id, entity_id FROM seed)"""


@query("grf05_neighborhood_nodes", "WITH " + WALK + """
SELECT tenant_id, entity_id, 0 AS hop FROM seed UNION ALL SELECT tenant_id, entity_id, 1 FROM hop1
UNION ALL SELECT tenant_id, entity_id, 2 FROM hop2""")
def _(kb):
    return kb.adjacency.neighborhood(seeds(kb), hops=2)[0]


@query("grf05_neighborhood_edges", "WITH " + WALK + """,
front AS (SELECT tenant_id, entity_id FROM seed UNION ALL SELECT * FROM hop1)
SELECT DISTINCT e.tenant_id, e.relation_id FROM kb_edges e JOIN front f ON f.tenant_id = e.tenant_id
  AND f.entity_id IN (e.source_entity, e.target_entity)""")
def _(kb):
    return kb.adjacency.neighborhood(seeds(kb), hops=2)[1].select("tenant_id", "relation_id")


@query("grf05_neighborhood_of_edge_table", "WITH " + WALK + """
SELECT tenant_id, entity_id, 0 AS hop FROM seed UNION ALL SELECT tenant_id, entity_id, 1 FROM hop1
UNION ALL SELECT tenant_id, entity_id, 2 FROM hop2""")
def _(kb):
    return graph.neighborhood(kb.edges, seeds(kb), hops=2, checkpoint=True)[0]


@query("grf06_typed_edges", "WITH " + SEEDS + """
SELECT e.tenant_id, relation_id, source_entity, target_entity, source_count FROM kb_edges e
JOIN seed s ON s.tenant_id = e.tenant_id AND s.entity_id IN (source_entity, target_entity)
WHERE relation_type = 'owns' QUALIFY row_number() OVER (PARTITION BY e.tenant_id ORDER BY relation_id) <= 1000""")
def _(kb):
    return graph.typed_edges(kb.edges, ["owns"], seeds(kb), limit=5000).select(
        "tenant_id", "relation_id", "source_entity", "target_entity", "source_count")


@query("grf07_path_text", """
SELECT relation_id, source_entity || ' -[' || relation_type || ']-> ' || target_entity AS path FROM kb_edges""")
def _(kb):
    return kb.edges.select("relation_id", graph.explain_path(
        F.col("source_entity"), F.col("relation_type"), F.col("target_entity")).alias("path"))


@query("grf08_neighbors_of_node", "WITH " + SEEDS + """
SELECT w.tenant_id, w.a AS node, w.relation_id, w.b AS other_id, coalesce(e.name, left(w.b, 12)) AS name,
       coalesce(e.type, '?') AS type
FROM both_ways w JOIN seed s ON s.tenant_id = w.tenant_id AND s.entity_id = w.a
LEFT JOIN (SELECT * FROM kb_entities WHERE embedding IS NULL) e ON e.tenant_id = w.tenant_id AND e.entity_id = w.b""")
def _(kb):
    return graph.neighbors_of(kb.edges, kb.entities.filter("embedding is null"), seeds(kb)).select(
        "tenant_id", "node", "relation_id", "other_id", "name", "type")


VISIBLE = """vis AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY degree DESC, entity_id) AS rank
  FROM kb_degrees WHERE degree >= 2 AND contains(lower(name), 'r')) WHERE rank <= 80)"""


def visible(kb):
    return graph.filter_nodes(kb.degrees, hide_isolated=True, min_degree=2, search="R", top_n=80)


@query("grf09_filter_nodes", "WITH " + VISIBLE + " SELECT tenant_id, entity_id, degree, rank FROM vis")
def _(kb):
    return visible(kb).select("tenant_id", "entity_id", "degree", "rank")


@query("grf09_filter_edges", "WITH " + VISIBLE.replace("rank <= 80", "rank <= 8000") + """
SELECT relation_id FROM kb_edges e WHERE relation_type = 'develops'
  AND EXISTS (SELECT 1 FROM vis v WHERE v.tenant_id = e.tenant_id AND v.entity_id = e.source_entity)
  AND EXISTS (SELECT 1 FROM vis v WHERE v.tenant_id = e.tenant_id AND v.entity_id = e.target_entity)""")
def _(kb):
    nodes = graph.filter_nodes(kb.degrees, hide_isolated=True, min_degree=2, search="R", top_n=8000)
    return graph.filter_edges(kb.edges, nodes, "develops").select("relation_id")


def requirement_edges(kb):
    """Part requires part: the supplier number of each line read as a part number."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return kb.raw("lineitem").select(
        F.concat(F.lit("t"), (p % 4).cast("string")).alias("tenant_id"),
        F.concat(F.lit("part_"), p.cast("string")).alias("source_entity"),
        F.when(F.col("l_linestatus") == "O", "depends_on").otherwise("caused_by").alias("relation_type"),
        F.concat(F.lit("part_"), s.cast("string")).alias("target_entity"))


@query("grf10_cycles", """
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT 't' || (l_partkey % 4) AS tenant_id, 'part_' || l_partkey AS s, 'part_' || l_suppkey AS t,
       CASE WHEN l_linestatus = 'O' THEN 'depends_on' ELSE 'caused_by' END AS relation_type FROM lineitem),
reach AS (SELECT tenant_id, relation_type, s AS start, t AS node FROM e
          WHERE (tenant_id, relation_type, s) IN (SELECT (tenant_id, relation_type, t) FROM e)
          UNION
          SELECT r.tenant_id, r.relation_type, r.start, e.t FROM reach r JOIN e
            ON e.tenant_id = r.tenant_id AND e.relation_type = r.relation_type AND e.s = r.node)
SELECT tenant_id, relation_type, start AS entity_id FROM reach WHERE start = node""")
def _(kb):
    return graph.cycle_nodes(requirement_edges(kb))


@query("grf11_count_by_type", "SELECT tenant_id, type, count(*) AS n FROM kb_entities GROUP BY 1, 2")
def _(kb):
    return graph.counts_by(kb.entities, "type")


@query("grf11_count_by_relation", "SELECT tenant_id, relation_type, count(*) AS n FROM kb_edges GROUP BY 1, 2")
def _(kb):
    return graph.counts_by(kb.edges, "relation_type")
