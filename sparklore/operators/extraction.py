"""Extraction: request tables for a model, and fact, entity and relation rows from its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklore.functions import responses as rs
from sparklore.functions.relations import normalize_relation, relation_id
from sparklore.functions.text import content_hash, strip
from sparklore.operators.governance import ENTITY_TYPES

INSTRUCTIONS = ("Extract the facts and entities that the numbered spans state. Answer with one JSON object "
                "{\"facts\": [...], \"entities\": [...]}; name the span numbers of each item. Entity types: ")


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda s, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), s)), "\n")


def requests(spans: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """One request row per chunk: numbered spans and the system text with the tenant's types.

    The spans of one chunk are bounded by the chunk size, so collecting them is safe.
    """
    per_chunk = spans.groupBy("tenant_id", "document_id", "chunk_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("span_no", "content"))), lambda s: s["content"]).alias("texts"))
    types = F.lit("/".join(ENTITY_TYPES))
    if settings is not None:
        per_chunk = per_chunk.join(settings.select("tenant_id", "entity_types", "custom_rules"), "tenant_id", "left")
        rules = F.coalesce("custom_rules", F.lit(""))
        types = F.concat(F.coalesce(F.col("entity_types"), types),
                         F.when(strip(rules) != "", F.concat(F.lit("\n\nRules:\n"), strip(rules))).otherwise(""))
    return per_chunk.select("tenant_id", "document_id", F.col("chunk_id").alias("custom_id"),
                            F.concat(F.lit(INSTRUCTIONS), types).alias("system_text"),
                            F.concat(F.lit("spans:\n"), numbered(F.col("texts"))).alias("user_text"))


def parsed(answers: DataFrame, column: str = "response") -> DataFrame:
    return answers.withColumn("r", rs.parse(F.col(column), rs.EXTRACT_SCHEMA))


def span_lists(spans: DataFrame) -> DataFrame:
    """Ordered span ids of each chunk (bounded by the chunk size)."""
    return spans.groupBy("tenant_id", "document_id", "chunk_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("span_no", "span_id"))), lambda s: s["span_id"]).alias("span_ids"))


def facts_of(answers: DataFrame, spans: DataFrame) -> DataFrame:
    rows = parsed(answers).join(span_lists(spans), ["tenant_id", "document_id", "chunk_id"], "left").withColumn(
        "span_ids", F.coalesce("span_ids", F.array().cast("array<string>")))
    f = rows.select("tenant_id", "document_id", "chunk_id", "span_ids", F.posexplode("r.facts").alias("n", "f"))
    out = f.select("tenant_id", "document_id", "chunk_id", "n",
                   *[F.coalesce(f"f.{c}", F.lit("")).alias(a) for c, a in
                     [("subject", "subject_entity"), ("predicate", "predicate"), ("object", "object_value")]],
                   F.col("f.qualifiers").alias("qualifiers"),
                   rs.pick_spans(F.col("f.source_span_index"), F.col("span_ids")).alias("source_span_ids"))
    return out.withColumn("fact_id", F.concat(F.lit("ft_"), F.substring(
        content_hash("tenant_id", "chunk_id", "n", "subject_entity", "predicate", "object_value"), 1, 16)))


def entities_of(answers: DataFrame, spans: DataFrame) -> DataFrame:
    rows = parsed(answers).join(span_lists(spans), ["tenant_id", "document_id", "chunk_id"], "left").withColumn(
        "span_ids", F.coalesce("span_ids", F.array().cast("array<string>")))
    e = rows.select("tenant_id", "document_id", "chunk_id", "span_ids", F.posexplode("r.entities").alias("n", "e"))
    return e.filter(F.coalesce("e.name", F.lit("")) != "").select(
        "tenant_id", "document_id", "chunk_id", "n", "e.name",
        F.coalesce("e.type", F.lit("concept")).alias("type"),
        rs.pick_spans(F.col("e.span_index"), F.col("span_ids")).alias("mention_span_ids"),
        F.concat(F.lit("en_"), F.substring(content_hash("tenant_id", "chunk_id", "n", "e.name"), 1, 16)).alias("entity_id"))


def rule_matches(texts: DataFrame, patterns: list, column: str = "content") -> DataFrame:
    """(subject, predicate, object) of every match of every pattern, and the entity types it implies.

    ``patterns``: (expression with two groups, predicate, suffix of the object, type of the subject, of the object).
    """
    def found(pattern, predicate, suffix, subject_type, object_type):
        both = F.arrays_zip(F.regexp_extract_all(column, F.lit("(?U)" + pattern), F.lit(1)).alias("s"),
                            F.regexp_extract_all(column, F.lit("(?U)" + pattern), F.lit(2)).alias("o"))
        return F.transform(both, lambda z: F.struct(
            z["s"].alias("subject"), F.lit(predicate).alias("predicate"),
            F.concat(z["o"], F.lit(suffix)).alias("object"), F.lit(subject_type).alias("subject_type"),
            F.lit(object_type).cast("string").alias("object_type")))

    hits = F.flatten(F.array(*[found(*rule) for rule in patterns]))
    keep = [c for c in texts.columns if c != column]
    return texts.select(*keep, F.posexplode(hits).alias("n", "h")).select(*keep, "n", "h.*")


def rule_entities(matches: DataFrame) -> DataFrame:
    keep = [c for c in matches.columns if c not in ("n", "subject", "predicate", "object", "subject_type", "object_type")]
    return matches.select(*keep, F.explode(F.array(
        F.struct(F.col("subject").alias("name"), F.col("subject_type").alias("type")),
        F.struct(F.col("object").alias("name"), F.col("object_type").alias("type")))).alias("e")).select(
        *keep, "e.*").filter("type is not null").distinct()


def join_batch(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Every requested unit with its answer; failed or missing ones get an empty answer.

    Ids are unique within a tenant only. Of several answers to a unit the last in text order of those that
    succeeded counts, so a repeated delivery adds no rows.
    """
    ok = (results.filter("type = 'succeeded'").groupBy("tenant_id", "custom_id").agg(F.max("text").alias("text")))
    return wanted.join(ok, ["tenant_id", "custom_id"], "left").withColumn(
        "response", F.coalesce("text", F.lit('{"facts":[],"entities":[]}'))).drop("text")


def name_index(entities: DataFrame) -> DataFrame:
    """One id per tenant and lower-case name: the smallest."""
    return entities.groupBy("tenant_id", F.lower("name").alias("name_key")).agg(F.min("entity_id").alias("entity_id"))


def parse_relations(answers: DataFrame) -> DataFrame:
    """Relation mentions of model answers (tenant_id, response, span_ids): source, relation_type, target names
    and the ids of the spans that an answer points to. Answers that are no JSON object give no rows.
    """
    rows = answers.withColumn("r", F.explode(rs.parse(F.col("response"), rs.RELATION_SCHEMA)["relations"]))
    keep = [c for c in answers.columns if c not in ("response", "span_ids")]
    return rows.select(*keep, "r.source", "r.relation_type", "r.target",
                       rs.pick_spans(F.col("r.source_span_index"), F.col("span_ids")).alias("source_span_ids"))


def relations_of(answers: DataFrame, entities: DataFrame) -> DataFrame:
    """Relation rows (tenant_id, source, relation_type, target names) with ids; unknown names
    and self edges dropped."""
    idx = name_index(entities)
    src = idx.select("tenant_id", F.col("name_key").alias("sk"), F.col("entity_id").alias("source_entity"))
    tgt = idx.select("tenant_id", F.col("name_key").alias("tk"), F.col("entity_id").alias("target_entity"))
    named = answers.withColumns({"sk": F.lower("source"), "tk": F.lower("target")})
    return (named.join(src, ["tenant_id", "sk"]).join(tgt, ["tenant_id", "tk"])
            .filter("source_entity <> target_entity")
            .withColumn("relation_type", normalize_relation(F.coalesce("relation_type", F.lit("references"))))
            .withColumn("relation_id", relation_id("tenant_id", "source_entity", "relation_type", "target_entity"))
            .drop("sk", "tk"))


def provenance_rule(facts: DataFrame, has_span: Column) -> DataFrame:
    return facts.withColumn("provenance", F.coalesce("provenance", F.when(has_span, "extracted").otherwise("inferred")))


def repoint(facts: DataFrame, canonical: DataFrame) -> DataFrame:
    """Subject and object names replaced by canonical ids where the name is known.

    ``canonical`` has unique (tenant_id, name_key) rows; which join strategy is used
    is left to the size statistics.
    """
    s = canonical.select("tenant_id", F.col("name_key").alias("sk"), F.col("entity_id").alias("sid"))
    o = canonical.select("tenant_id", F.col("name_key").alias("ok"), F.col("entity_id").alias("oid"))
    keyed = facts.withColumns({"sk": F.lower("subject_entity"), "ok": F.lower("object_value")})
    return (keyed.join(s, ["tenant_id", "sk"], "left").join(o, ["tenant_id", "ok"], "left")
            .withColumns({"subject_entity": F.coalesce("sid", "subject_entity"),
                          "object_value": F.coalesce("oid", "object_value")}).drop("sk", "ok", "sid", "oid"))
