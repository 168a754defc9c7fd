"""Typed graph operators: merging sightings, degrees, neighbourhoods, filters, cycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklore.functions.lifecycle import source_confidence
from sparklore.functions.relations import (ACYCLIC_TYPES, names_inverse, normalize_relation,
                                           relation_id, spec_table)
from sparklore.session import cut_lineage, stored_table

TRIPLE = ["tenant_id", "source_entity", "relation_type", "target_entity"]


def normalize_sightings(sightings: DataFrame, mode: str = "strict", flip_inverse: bool = False) -> DataFrame:
    """Sightings with a known relation type; optionally turn edges named by their inverse."""
    kind = F.col("relation_type")
    out = sightings
    if flip_inverse:
        turn = names_inverse(kind)
        out = out.withColumns({
            "source_entity": F.when(turn, F.col("target_entity")).otherwise(F.col("source_entity")),
            "target_entity": F.when(turn, F.col("source_entity")).otherwise(F.col("target_entity"))})
    return out.withColumn("relation_type", normalize_relation(kind, mode))


def merge_sightings(sightings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One row per triple with its number of sightings and the confidence they give.

    A triple seen once keeps the confidence of that sighting (column ``confidence``, by default 1);
    with more sightings the number of them decides.
    Partial counts are made before the shuffle, so a triple that holds a third of all
    sightings costs one row per map task. Span ids stay in ``sighting_spans``: an array of
    them would have no size bound.
    """
    said = F.min_by("confidence", "seq") if "confidence" in sightings.columns else F.lit(None).cast("double")
    new = sightings.groupBy(*TRIPLE).agg(F.count(F.lit(1)).alias("n"), F.max("seen_at").alias("last_confirmed"),
                                         said.alias("own"))
    if existing is not None:
        old = existing.select(*TRIPLE, F.col("source_count").alias("old_n"), F.col("confidence").alias("old_own"),
                              F.col("last_confirmed").alias("old_seen"))
        new = new.join(old, TRIPLE, "full").select(
            *TRIPLE, (F.coalesce("n", F.lit(0)) + F.coalesce("old_n", F.lit(0))).alias("n"),
            F.coalesce("last_confirmed", "old_seen").alias("last_confirmed"), F.coalesce("old_own", "own").alias("own"))
    return new.select(
        relation_id(*TRIPLE).alias("relation_id"), *TRIPLE, F.col("n").alias("source_count"),
        F.when(F.col("n") > 1, source_confidence(F.col("n"))).otherwise(F.coalesce("own", F.lit(1.0))).alias("confidence"),
        "last_confirmed")


def sighting_spans(sightings: DataFrame) -> DataFrame:
    """Link rows (relation, span) in first-seen order."""
    return (sightings.filter(F.col("span_id").isNotNull())
            .groupBy(*TRIPLE, "span_id").agg(F.min("seq").alias("first_seq"))
            .select(relation_id(*TRIPLE).alias("relation_id"), "tenant_id", "span_id", "first_seq"))


def end_points(edges: DataFrame) -> DataFrame:
    """Both ends of every edge; a self loop gives its node twice."""
    return edges.select("tenant_id", F.explode(F.array("source_entity", "target_entity")).alias("entity_id"))


def degrees(entities: DataFrame, edges: DataFrame) -> DataFrame:
    counted = end_points(edges).groupBy("tenant_id", "entity_id").agg(F.count(F.lit(1)).alias("degree"))
    return (entities.select("tenant_id", "entity_id", "name", "type")
            .join(counted, ["tenant_id", "entity_id"], "left")
            .withColumn("degree", F.coalesce("degree", F.lit(0))))


def _touching(edges: DataFrame, frontier: DataFrame) -> DataFrame:
    """Edges with an end in the frontier: two equi-joins instead of one OR condition."""
    keys = frontier.columns
    lookup = [k for k in keys if k != "entity_id"]
    sides = [edges.join(frontier.withColumnRenamed("entity_id", end), ["tenant_id", end])
             for end in ("source_entity", "target_entity")]
    cols = [*edges.columns, *[k for k in lookup if k not in edges.columns]]
    return sides[0].select(cols).unionByName(sides[1].select(cols))


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int = 1,
                 checkpoint: bool = False) -> tuple[DataFrame, DataFrame]:
    """Undirected expansion from seed rows (tenant_id, entity_id [, query key columns]).

    Returns (nodes with their hop, distinct edges). Any extra key columns of ``seeds``
    travel along, so one job expands the seeds of a whole table of questions. With
    ``checkpoint`` the edges and each frontier are written once instead of derived again per hop.
    """
    keys = seeds.columns
    if checkpoint and hops > 1:
        edges = cut_lineage(edges)  # read twice per hop
    visited = seeds.distinct().withColumn("hop", F.lit(0))
    frontier, found = seeds.distinct(), []
    for hop in range(1, max(1, hops) + 1):
        touched = _touching(edges, frontier)
        found.append(touched)
        extra = [k for k in keys if k not in ("tenant_id", "entity_id")]
        reached = touched.select("tenant_id", *extra, F.explode(
            F.array("source_entity", "target_entity")).alias("entity_id")).distinct()
        frontier = reached.join(visited.select(*keys), keys, "left_anti").select(*keys)
        if checkpoint:
            frontier = cut_lineage(frontier)
        visited = visited.unionByName(frontier.withColumn("hop", F.lit(hop)))
    return visited, reduce(DataFrame.unionByName, found).distinct()


def typed_edges(edges: DataFrame, relation_types: list[str] | None = None,
                entity_ids: DataFrame | None = None, limit: int | None = 200) -> DataFrame:
    """Edges of some types and/or touching some entities, by id, at most ``limit`` (1 to 1000) of each tenant.

    ``relation_types`` may be any of the names that stand for a type.
    """
    out = edges
    if relation_types:
        asked = F.array(*[normalize_relation(F.lit(t)) for t in relation_types])
        out = out.filter(F.array_contains(asked, F.col("relation_type")))
    if entity_ids is not None:
        out = _touching(out, entity_ids.select("tenant_id", "entity_id").distinct()).distinct()
    if limit is not None:
        w = Window.partitionBy("tenant_id").orderBy("relation_id")
        out = (out.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= min(max(limit, 1), 1000))
               .drop("_nth"))
    return out


def explain_path(source: Column, kind: Column, target: Column) -> Column:
    return F.format_string("%s -[%s]-> %s", source, normalize_relation(kind), target)


def neighbors_of(edges: DataFrame, entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per edge of each requested node with its other end; unknown ends get type '?'."""
    wanted = nodes.select("tenant_id", F.col("entity_id").alias("node")).distinct()
    out_edges = edges.join(wanted, (edges["tenant_id"] == wanted["tenant_id"])
                           & (edges["source_entity"] == wanted["node"])).select(
        edges["tenant_id"], "node", "relation_id", "relation_type", F.col("target_entity").alias("other_id"))
    in_edges = edges.join(wanted, (edges["tenant_id"] == wanted["tenant_id"])
                          & (edges["target_entity"] == wanted["node"])).filter(
        F.col("source_entity") != F.col("target_entity")).select(
        edges["tenant_id"], "node", "relation_id", "relation_type", F.col("source_entity").alias("other_id"))
    ends = entities.select("tenant_id", F.col("entity_id").alias("other_id"), "name", "type")
    return (out_edges.unionByName(in_edges).join(ends, ["tenant_id", "other_id"], "left")
            .withColumns({"name": F.coalesce("name", F.substring("other_id", 1, 12)),
                          "type": F.coalesce("type", F.lit("?"))}))


def filter_nodes(nodes: DataFrame, *, hide_isolated: bool = False, min_degree: int = 0,
                 type_filter: str | None = None, search: str = "", top_n: int = 80) -> DataFrame:
    """Nodes with a ``degree`` column, filtered, then the ``top_n`` of each tenant by degree."""
    out = nodes
    if hide_isolated:
        out = out.filter("degree > 0")
    if min_degree > 0:
        out = out.filter(F.col("degree") >= min_degree)
    if type_filter:
        out = out.filter(F.col("type") == type_filter)
    if search.strip():
        out = out.filter(F.lower("name").contains(search.lower()))
    w = Window.partitionBy("tenant_id").orderBy(F.desc("degree"), "entity_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)


def filter_edges(edges: DataFrame, visible: DataFrame, relation: str | None = None) -> DataFrame:
    out = edges if relation is None else edges.filter(F.col("relation_type") == relation)
    for end in ("source_entity", "target_entity"):
        keep = visible.select("tenant_id", F.col("entity_id").alias(end))
        out = out.join(keep, ["tenant_id", end], "left_semi")
    return out


def counts_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy("tenant_id", column).agg(F.count(F.lit(1)).alias("n"))


def with_attributes(edges: DataFrame) -> DataFrame:
    """Edges with inverse, acyclic and symmetric marks (broadcast of the fixed 15-row table)."""
    return edges.join(F.broadcast(spec_table(edges.sparkSession)), "relation_type", "left")


CYCLE_KEY = ["tenant_id", "relation_type"]


def _steps(n: int) -> int:
    """Pointer doublings that pass ``n`` nodes."""
    return max(1, n).bit_length() + 1


def _contract(core: DataFrame, inward: bool) -> dict[str, DataFrame] | None:
    """Merges every node with a single edge in (``inward``; else out) into the other end of that edge, along whole trees at once.

    A cycle through a merged node passes its tree's root, so the smaller graph has the same strongly connected parts. Returns core (the
    smaller graph), loops (nodes that got an edge to themselves), rings (node, label: cycles that nothing enters or leaves by
    merged ends, complete parts) and what ``_expand`` needs; None if there is nothing to merge.
    """
    key, (a, b) = CYCLE_KEY, ("s", "t") if inward else ("t", "s")
    parents = stored_table(core.groupBy(*key, F.col(b).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(a).alias("p"))
                          .filter("n = 1").select(*key, "v", "p"))
    merged = parents.count()
    if not merged:
        return None
    ptr = parents.select(*key, "v", F.col("p").alias("top"), F.col("v").alias("low"))
    for _ in range(_steps(merged)):
        ahead = ptr.select(*key, F.col("v").alias("top"), F.col("top").alias("further"), F.col("low").alias("other"))
        ptr = stored_table(ptr.join(ahead, [*key, "top"], "left").select(
            *key, "v", F.coalesce("further", "top").alias("top"), F.least("low", F.coalesce("other", "low")).alias("low")))
    # Who still points at a merged node hangs on a ring of them, and after so many steps points at the ring itself.
    names = parents.select(*key, F.col("v").alias("top"))
    hanging = stored_table(ptr.join(names, [*key, "top"], "left_semi"))
    on_ring = hanging.select(*key, F.col("top").alias("v")).distinct()
    rings = stored_table(hanging.join(on_ring, [*key, "v"], "left_semi").select(*key, F.col("v").alias("node"), F.col("low").alias("label")))
    roots = stored_table(ptr.join(hanging.select(*key, "v"), [*key, "v"], "left_anti").select(*key, "v", F.col("top").alias("root")))
    # The one edge at the merged end of a node is its tree's; all others end at roots.
    others = core.join(parents.select(*key, F.col("v").alias(b)), [*key, b], "left_anti")
    others = stored_table(others.join(hanging.select(*key, F.col("v").alias(a)), [*key, a], "left_anti").select(*key, "s", "t"))
    moved = (others.join(roots.withColumnRenamed("v", a), [*key, a], "left").withColumn(a, F.coalesce("root", a)).drop("root")
             .select(*key, "s", "t").distinct())
    moved = stored_table(moved)
    trees = stored_table(parents.join(roots.select(*key, "v"), [*key, "v"], "left_semi"))
    return {"core": moved.filter("s <> t"), "loops": moved.filter("s = t").select(*key, F.col("s").alias("node"), F.col("s").alias("label")),
            "rings": rings, "roots": roots, "parents": trees, "others": others.select(*key, F.col(a).alias("v"), F.col(b).alias("end"))}


def _expand(found: DataFrame, level: dict[str, DataFrame]) -> DataFrame:
    """Nodes on cycles (node, label) before a contraction, from those after it.

    A merged node is on a cycle if it, or a node below it in its tree, has another edge to the part of its root; so the nodes with such
    edges are marked, and with them all nodes up to the root, by pointer doubling.
    """
    key = CYCLE_KEY
    back = (level["others"].join(found.withColumnRenamed("node", "end"), [*key, "end"]).join(level["roots"], [*key, "v"])
            .join(found.select(*key, F.col("node").alias("root"), F.col("label").alias("own")), [*key, "root"]).filter("label = own"))
    marked, jump = stored_table(back.select(*key, "v", "label").distinct()), level["parents"]
    names = level["parents"].select(*key, F.col("v").alias("p"))
    while True:
        inner = stored_table(jump.join(names, [*key, "p"], "left_semi").select(*key, "v", "p"))     # jumps that end below the root
        if inner.isEmpty():
            break
        up = marked.join(inner, [*key, "v"]).select(*key, F.col("p").alias("v"), "label")
        marked = stored_table(marked.unionByName(up).distinct())
        jump = inner.join(inner.select(*key, F.col("v").alias("p"), F.col("p").alias("q")), [*key, "p"]).select(*key, "v", F.col("q").alias("p"))
    return stored_table(found.unionByName(marked.withColumnRenamed("v", "node").select(found.columns)))


def _trimmed(core: DataFrame) -> DataFrame:
    """Without the edges whose source nobody enters or whose target nobody leaves."""
    key = CYCLE_KEY
    heads, tails = core.select(*key, F.col("t").alias("s")).distinct(), core.select(*key, F.col("s").alias("t")).distinct()
    return stored_table(core.join(heads, [*key, "s"], "left_semi").join(tails, [*key, "t"], "left_semi").select(*key, "s", "t"))


def cycle_nodes(edges: DataFrame, relation_types: list[str] | None = None, max_rounds: int = 200) -> DataFrame:
    """Nodes that lie on a directed cycle of one acyclic relation type.

    Rounds of trimming and contraction: nodes with a single edge in or out are merged into the other end, whole trees at once by pointer
    doubling, so paths, trees and ladders of any length vanish in a few rounds. What cannot be merged is split into strongly
    connected parts (``_cycle_parts``); then the contractions are undone one by one. Raises if ``max_rounds`` do not
    suffice; never returns a part of the result.
    """
    kinds, key = relation_types or ACYCLIC_TYPES, CYCLE_KEY
    whole = cut_lineage(edges.filter(F.col("relation_type").isin(kinds))
                        .select("tenant_id", "relation_type", F.col("source_entity").alias("s"),
                                F.col("target_entity").alias("t")).distinct())
    core, levels = whole.filter("s <> t"), []
    own = whole.filter("s = t").select(*key, F.col("s").alias("node"), F.col("s").alias("label"))
    for _ in range(max_rounds):
        before = core.count()
        core = _trimmed(core)
        merges = 0
        for inward in (True, False):
            level = _contract(core, inward)
            if level is not None:
                levels.append(level)
                core, merges = level["core"], merges + 1
        if not merges and core.count() == before or core.isEmpty():
            break
    else:
        raise RuntimeError("contraction did not settle; raise max_rounds")
    parts = _cycle_parts(core, max_rounds)
    found = own.limit(0) if parts is None else parts.select(*key, "node", "label")
    for level in reversed(levels):
        # A loop counts by itself unless its node is in a larger part already.
        alone = level["loops"].join(found.select(*key, "node"), [*key, "node"], "left_anti")
        found = _expand(found.unionByName(alone), level).unionByName(level["rings"])
    return found.unionByName(own).select(*key, F.col("node").alias("entity_id")).distinct()


def _cycle_parts(core: DataFrame, max_rounds: int) -> DataFrame | None:
    """Nodes on cycles with a label of their strongly connected part; None if there are none.

    First trim, round by round, every edge whose source nobody enters or whose target nobody
    leaves. What remains are cycles and the paths between them; there a node is on a cycle
    if its strongly connected part has two nodes or it has a self loop. Parts are found by
    spreading the smallest label forward and backward, one label pair per round.
    """
    key = CYCLE_KEY

    def trim(e):
        size, rounds = -1, 0
        e = cut_lineage(e)
        while rounds < max_rounds:
            now = e.count()
            if now == size or now == 0:
                return e
            size, rounds = now, rounds + 1
            heads = e.select(*key, F.col("t").alias("s")).distinct()
            tails = e.select(*key, F.col("s").alias("t")).distinct()
            e = cut_lineage(e.join(heads, [*key, "s"], "left_semi").join(tails, [*key, "t"], "left_semi"))
        raise RuntimeError("trim did not settle; raise max_rounds")

    def spread(e, src, dst):
        """Smallest label that can reach each node along src -> dst."""
        labels = cut_lineage(e.select(*key, F.explode(F.array("s", "t")).alias("node")).distinct()
                             .withColumn("label", F.col("node")))
        for _ in range(max_rounds):
            sent = (e.select(*key, F.col(src).alias("node"), F.col(dst).alias("to"))
                    .join(labels, [*key, "node"]).select(*key, F.col("to").alias("node"), "label"))
            nxt = cut_lineage(labels.unionByName(sent).groupBy(*key, "node").agg(F.min("label").alias("label")))
            changed = nxt.join(labels, [*key, "node", "label"], "left_anti").isEmpty()
            labels = nxt
            if changed:
                return labels
        raise RuntimeError("labels did not settle; raise max_rounds")

    found = None
    core = trim(core)
    for _ in range(max_rounds):
        if core.isEmpty():
            break
        fwd, bwd = spread(core, "s", "t"), spread(core, "t", "s")
        both = fwd.withColumnRenamed("label", "f").join(bwd.withColumnRenamed("label", "b"), [*key, "node"])
        part = both.filter("f = b").select(*key, "node", F.col("f").alias("label"))
        sizes = part.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"))
        loops = core.filter("s = t").select(*key, F.col("s").alias("node")).distinct()
        hit = part.join(sizes.filter("n > 1"), [*key, "label"], "left_semi").select(*key, "node", "label").unionByName(
            part.select(*key, "node", "label").join(loops, [*key, "node"], "left_semi")).distinct()
        found = hit if found is None else found.unionByName(hit)
        found = cut_lineage(found)
        done = part.select(*key, F.col("node"))
        core = core.join(done.withColumnRenamed("node", "s"), [*key, "s"], "left_anti").join(
            done.withColumnRenamed("node", "t"), [*key, "t"], "left_anti")
        core = trim(core)
    else:
        raise RuntimeError("cycles did not settle; raise max_rounds")
    return found
