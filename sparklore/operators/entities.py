"""Entity resolution: block keys, matching tiers, merging, upserts, lookup and linking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklore.functions import text as tx
from sparklore.functions import vectors as vec
from sparklore.functions.similarity import candidate_names, containment_join, first_similar, similar_names
from sparklore.session import cut_lineage

# Thresholds of the fuzzy and the embedding tier, pairs kept per entity.
NAME_RATIO, EMBEDDING_COSINE, EMBEDDING_PAIRS = 0.92, 0.85, 2
BLOCK = ["tenant_id", "name_block"]


def block_key(name: Column, kind: Column) -> Column:
    """First word, lower case, word characters only, 8 of them, and the type."""
    first = F.get(F.split(tx.strip(name), r"(?U)\s+"), F.lit(0))
    word = F.regexp_replace(F.lower(first), r"(?U)[^\w]", "")
    return F.concat(F.substring(F.when(tx.is_blank(name), F.lower(name)).otherwise(word), 1, 8), F.lit("|"), kind)


def with_block(entities: DataFrame) -> DataFrame:
    return entities.withColumns({"name_block": block_key(F.col("name"), F.col("type")),
                                 "name_key": F.lower("name")})


def block_candidates(new: DataFrame, known: DataFrame) -> DataFrame:
    """How many known entities share the block of each new one; pairs are never listed."""
    size = with_block(known).groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("candidates"))
    return with_block(new).select(*BLOCK, "entity_id").join(size, BLOCK, "left").withColumn(
        "candidates", F.coalesce("candidates", F.lit(0)))


def exact_matches(new: DataFrame, known: DataFrame) -> DataFrame:
    """(entity_id, canonical_id): same block and lower-case name; the smallest known id."""
    owner = with_block(known).groupBy(*BLOCK, "name_key").agg(F.min("entity_id").alias("canonical_id"))
    return with_block(new).join(owner, [*BLOCK, "name_key"]).select("tenant_id", "entity_id", "canonical_id")


def alias_matches(new: DataFrame, known: DataFrame) -> DataFrame:
    owner = (with_block(known).select(*BLOCK, "entity_id", F.explode("aliases").alias("alias"))
             .groupBy(*BLOCK, F.lower("alias").alias("name_key")).agg(F.min("entity_id").alias("canonical_id")))
    return with_block(new).join(owner, [*BLOCK, "name_key"]).select("tenant_id", "entity_id", "canonical_id")


def fuzzy_matches(new: DataFrame, known: DataFrame, threshold: float = NAME_RATIO) -> DataFrame:
    a = with_block(new).select(*BLOCK, F.col("name_key").alias("name"))
    b = with_block(known).select(*BLOCK, F.col("name_key").alias("name"))
    pairs = candidate_names(a, b, BLOCK, threshold)
    owner = with_block(known).groupBy(*BLOCK, F.col("name_key").alias("right_name")).agg(
        F.min("entity_id").alias("canonical_id"))
    best = first_similar(pairs.join(owner, [*BLOCK, "right_name"]), BLOCK, threshold).withColumnRenamed("left_name", "name_key")
    return with_block(new).join(best, [*BLOCK, "name_key"]).select("tenant_id", "entity_id", "canonical_id", "ratio")


def embedding_matches(new: DataFrame, known: DataFrame, threshold: float = EMBEDDING_COSINE,
                      keep: int = EMBEDDING_PAIRS, salts: int = 8) -> DataFrame:
    """The best ``keep`` known entities of the same block with a cosine above ``threshold``.

    Vectors meet as blocks of rows inside a task; block pairs that cannot hold a match are
    skipped by their angles, and only matches leave the task.
    """
    a = vec.pack_blocks(with_block(new), BLOCK, "entity_id", "embedding")
    b = vec.pack_blocks(with_block(known), BLOCK, "entity_id", "embedding")
    hits = vec.block_matches(vec.join_blocks(a, b, BLOCK, salts, min_cosine=threshold), BLOCK,
                             threshold=threshold, top_k=keep, eps=1e-9)
    w = Window.partitionBy("tenant_id", "a_id").orderBy(F.desc(F.round("sim", 9)), "b_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep).select(
        "tenant_id", F.col("a_id").alias("entity_id"), F.col("b_id").alias("canonical_id"), "sim", "rank")


def merge_requests(pairs: DataFrame, new: DataFrame, known: DataFrame) -> DataFrame:
    """One JSON question per close pair for a model to decide."""
    a = new.select("tenant_id", "entity_id", F.struct("name", "type").alias("a"))
    b = known.select("tenant_id", F.col("entity_id").alias("canonical_id"), F.struct("name", "aliases").alias("b"))
    return (pairs.join(a, ["tenant_id", "entity_id"]).join(b, ["tenant_id", "canonical_id"])
            .select("tenant_id", "entity_id", "canonical_id", F.to_json(F.struct("a", "b")).alias("request")))


def resolve(new: DataFrame, known: DataFrame, verdicts: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(entity_id, canonical_id, tier): first hit of exact, alias or fuzzy, embedding with a
    merge verdict; otherwise the entity is new."""
    exact = exact_matches(new, known).select("tenant_id", "entity_id", F.struct(
        F.lit(1).alias("tier"), F.lit(0.0).alias("order"), "canonical_id").alias("hit"))
    names = alias_matches(new, known)
    if fuzzy:
        names = names.unionByName(fuzzy_matches(new, known).drop("ratio"))
    names = names.select("tenant_id", "entity_id", F.struct(
        F.lit(2).alias("tier"), F.lit(0.0).alias("order"), "canonical_id").alias("hit"))
    yes = verdicts.filter("merge").select("tenant_id", "entity_id", "canonical_id")
    close = embedding_matches(new, known).join(yes, ["tenant_id", "entity_id", "canonical_id"], "left_semi").select(
        "tenant_id", "entity_id", F.struct(F.lit(3).alias("tier"), F.col("rank").cast("double").alias("order"),
                                           "canonical_id").alias("hit"))
    first = exact.unionByName(names).unionByName(close).groupBy("tenant_id", "entity_id").agg(F.min("hit").alias("hit"))
    return new.select("tenant_id", "entity_id").join(first, ["tenant_id", "entity_id"], "left").select(
        "tenant_id", "entity_id", F.coalesce("hit.canonical_id", "entity_id").alias("canonical_id"),
        F.coalesce("hit.tier", F.lit(4)).alias("tier"))


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(tenant_id, node, component): smallest reachable id, over undirected pairs (a, b).

    Each round takes the smallest label among the neighbours and then the label of that
    label, so long chains shrink fast; rounds end when no label moves.
    """
    both = pairs.select("tenant_id", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                                       F.struct(F.col("b").alias("node"), F.col("a").alias("other"))))
                        .alias("e")).select("tenant_id", "e.*").distinct()
    both = cut_lineage(both)
    labels = both.groupBy("tenant_id", "node").agg(F.least(F.min("other"), F.min("node")).alias("component"))
    labels = cut_lineage(labels)
    for _ in range(max_rounds):
        seen = both.join(labels.select("tenant_id", F.col("node").alias("other"), F.col("component").alias("c")),
                         ["tenant_id", "other"]).groupBy("tenant_id", "node").agg(F.min("c").alias("c"))
        nxt = labels.join(seen, ["tenant_id", "node"]).select(
            "tenant_id", "node", F.least("component", "c").alias("component"))
        jump = nxt.select("tenant_id", F.col("node").alias("component"), F.col("component").alias("up"))
        nxt = cut_lineage(nxt.join(jump, ["tenant_id", "component"], "left").select(
            "tenant_id", "node", F.coalesce("up", "component").alias("component")))
        settled = nxt.join(labels, ["tenant_id", "node", "component"], "left_anti").isEmpty()
        labels = nxt
        if settled:
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")


def self_merge(new: DataFrame, fuzzy: bool = False) -> DataFrame:
    """(entity_id, canonical_id) among new entities: equal block and name share the smallest
    id; with ``fuzzy`` similar names join them, transitively."""
    keyed = with_block(new)
    owner = keyed.groupBy(*BLOCK, "name_key").agg(F.min("entity_id").alias("canonical_id"))
    if fuzzy:
        names = keyed.select(*BLOCK, F.col("name_key").alias("name"))
        close = similar_names(names, names, BLOCK, NAME_RATIO)
        ends = [owner.select(*BLOCK, F.col("name_key").alias(side), F.col("canonical_id").alias(out))
                for side, out in (("left_name", "a"), ("right_name", "b"))]
        pairs = close.join(ends[0], [*BLOCK, "left_name"]).join(ends[1], [*BLOCK, "right_name"])
        comp = connected_components(pairs.select("tenant_id", "a", "b"))
        owner = owner.join(comp.withColumnRenamed("node", "canonical_id"), ["tenant_id", "canonical_id"], "left") \
            .withColumn("canonical_id", F.coalesce("component", "canonical_id")).drop("component")
    return keyed.join(owner, [*BLOCK, "name_key"]).select("tenant_id", "entity_id", "canonical_id")


def upsert_entities(base: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Scalar columns of entities: known name and type stay, the last non-empty description wins."""
    # Dealt by entity first: names and descriptions are strings, which are folded by sorting, and before the shuffle that would sort
    # and spill whole input splits. One value per end of the order instead of one per column.
    said = F.when(F.col("seq").isNotNull() & (F.col("description") != ""), F.struct("seq", "description"))
    told = arrivals.select("tenant_id", "entity_id", "seq", "name", "type", "description").repartition("tenant_id", "entity_id")
    last = told.groupBy("tenant_id", "entity_id").agg(
        F.min_by(F.struct("name", "type"), "seq").alias("first"), F.max(said).alias("said")).select(
        "tenant_id", "entity_id", F.col("first.name").alias("n_name"), F.col("first.type").alias("n_type"),
        F.col("said.description").alias("n_desc"))
    return base.select("tenant_id", "entity_id", "name", "type", "description").join(
        last, ["tenant_id", "entity_id"], "full").select(
        "tenant_id", "entity_id", F.coalesce("name", "n_name").alias("name"), F.coalesce("type", "n_type").alias("type"),
        F.coalesce(F.nullif("n_desc", F.lit("")), "description", F.lit("")).alias("description"))


def entity_links(*tables: DataFrame) -> DataFrame:
    """Union of (entity, kind, value) rows for aliases, mentions and documents. Rows instead of
    arrays: a common entity may be mentioned by a third of all spans."""
    out = None
    for t in tables:
        rows = t.select("tenant_id", "entity_id", "kind", "value")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def lookup(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """Entity of each request row (request_id, tenant_id, entity_id or name), smallest id on ties."""
    by_id = requests.filter("entity_id is not null").join(
        entities.select("tenant_id", "entity_id", "name", "type").withColumnRenamed("name", "found_name"),
        ["tenant_id", "entity_id"]).select("request_id", "tenant_id", "entity_id", "found_name", "type")
    names = entities.groupBy("tenant_id", F.lower("name").alias("key")).agg(
        F.min(F.struct("entity_id", "name", "type")).alias("e"))
    by_name = (requests.filter("entity_id is null").withColumn("key", F.lower("name"))
               .join(names, ["tenant_id", "key"])
               .select("request_id", "tenant_id", "e.entity_id", F.col("e.name").alias("found_name"), "e.type"))
    return by_id.unionByName(by_name)


def link_entities(questions: DataFrame, entities: DataFrame, top_k: int = 5, salts: int = 8) -> DataFrame:
    """(tenant_id, qid, entity_id, sim) of a whole table of questions.

    The ``top_k`` nearest entities by vector, then up to ``top_k`` entities whose name
    contains the whole hint text at similarity 1, without repeats. Names are matched by the
    containment join with the hints as needles.
    """
    q = vec.pack_blocks(questions.filter(~vec.is_zero(F.col("vector"))), ["tenant_id"], "qid", "vector", rows=256)
    e = vec.pack_blocks(entities.filter("embedding is not null"), ["tenant_id"], "entity_id", "embedding")
    near = vec.block_matches(vec.join_blocks(q, e, ["tenant_id"], salts), ["tenant_id"], top_k=top_k)
    w = Window.partitionBy("tenant_id", "a_id").orderBy(F.desc(F.round("sim", 9)), "b_id")
    top = near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k).select(
        "tenant_id", F.col("a_id").alias("qid"), F.col("b_id").alias("entity_id"), "sim")
    hints = questions.select("tenant_id", "qid", F.lower("question").alias("needle"))
    names = entities.select("tenant_id", F.lower("name").alias("hay")).distinct().withColumn("name_key", F.col("hay"))
    found = containment_join(hints, names, "name_key").join(hints, ["tenant_id", "needle"])
    owners = entities.select("tenant_id", F.lower("name").alias("name_key"), "entity_id")
    h = Window.partitionBy("tenant_id", "qid").orderBy("entity_id")
    named = (found.join(owners, ["tenant_id", "name_key"]).select("tenant_id", "qid", "entity_id")
             .withColumn("rank", F.row_number().over(h)).filter(F.col("rank") <= top_k)
             .select("tenant_id", "qid", "entity_id", F.lit(1.0).alias("sim")))
    both = top.withColumn("by_name", F.lit(False)).unionByName(named.withColumn("by_name", F.lit(True)))
    return both.groupBy("tenant_id", "qid", "entity_id").agg(F.min_by("sim", "by_name").alias("sim"))
