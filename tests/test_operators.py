from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sparklore.functions import lifecycle as lc
from sparklore.functions import responses as rs
from sparklore.functions.relations import normalize_relation
from sparklore.functions.similarity import containment_join, similar_names
from sparklore.operators import entities as ent
from sparklore.operators import evaluation as ev
from sparklore.operators import facts as fct
from sparklore.operators import graph, maintenance as mnt, retrieval as ret


def test_life_cycle(spark):
    day = 86400.0
    row = spark.range(1).select(
        lc.retention(F.lit(70 * day), F.lit("depends_on"), 100 * day).alias("slow"),
        lc.retention(F.lit(70 * day), F.lit("current_status"), 100 * day).alias("fast"),
        lc.confidence(F.lit(3), F.lit(1.0), F.lit(False), F.lit(False)).alias("three"),
        lc.confidence(F.lit(1), F.lit(1.0), F.lit(False), F.lit(False)).alias("one"),
        lc.confidence(F.lit(3), F.lit(1.0), F.lit(True), F.lit(False)).alias("contra")).first()
    assert row.slow > row.fast and row.three > row.one and row.contra < row.three


def test_contradiction_winner(spark):
    facts = spark.createDataFrame([("t", "a", "S", "p", "x", 3, 100.0), ("t", "b", "s", "P", "y", 1, 50.0)],
                                  "tenant_id string, fact_id string, subject_entity string, predicate string, "
                                  "object_value string, source_count long, last_confirmed double")
    assert [tuple(r) for r in fct.resolve_groups(facts, 200.0).collect()] == [("t", "b", "a")]


def test_patches_are_applied_within_groups_by_one_shuffle(spark):
    rows = [("t", f"f{i}", f"S{i % 3}", "p" if i % 2 else "P", "xyz"[i % 3], 1 + i % 4, float(i % 5), i % 7 == 0, None) for i in range(60)]
    facts = spark.createDataFrame(rows, "tenant_id string, fact_id string, subject_entity string, predicate string, object_value string, "
                                  "source_count long, last_confirmed double, stale boolean, superseded_by string")
    want = {}
    for r in rows:
        mates = sorted((-m[5], -m[6], m[1]) for m in rows if m[2] == r[2])
        want[r[1]] = None if mates[0][2] == r[1] else mates[0][2]
    got = fct.resolve_in_place(facts, 100.0)
    assert got.columns == facts.columns
    assert {r.fact_id: (r.superseded_by, r.stale) for r in got.collect()} == {
        r[1]: (want[r[1]], r[7] or want[r[1]] is not None) for r in rows}
    assert {r.fact_id: r.superseded_by for r in fct.resolve_groups(facts, 100.0).collect()} == {k: v for k, v in want.items() if v}
    for df in (got, fct.resolve_groups(facts, 100.0)):
        assert df.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_check_in_place_equals_patches_and_meets_by_group_once(spark):
    rows = [("t", f"f{i}", f"S{i % 4}", "p" if i % 2 else "P", "x" if i % 4 == 3 else "xyz"[i % 3], 1 + i % 5, float(i % 6), i % 5 == 0, None, i % 2 == 0)
            for i in range(80)]
    facts = spark.createDataFrame(rows, "tenant_id string, fact_id string, subject_entity string, predicate string, object_value string, "
                                  "source_count long, last_confirmed double, stale boolean, superseded_by string, _changed boolean")
    patches = fct.check_on_write(facts, facts, 100.0)
    want = {r.fact_id: (r.superseded_by, r.stale) for r in fct.apply_patches(facts, patches).collect()}
    patched = {r.fact_id for r in patches.collect()}
    got = fct.check_in_place(facts, 100.0)
    assert {r.fact_id: (r.superseded_by, r.stale) for r in got.collect()} == want and patched
    assert {r.fact_id for r in got.filter("_changed").collect()} == patched | {r[1] for r in rows if r[9]}
    assert got.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_chains_of_neighbours_need_one_round(spark, monkeypatch):
    rows = [(f"t{i % 2}", f"f{i}", f"f{i + 2}") for i in range(0, 600)] + [("t0", "a", "b"), ("t0", "b", "c"), ("t0", "c", "b"), ("t1", "n", None)]
    tables = []
    monkeypatch.setattr(fct, "stored_table", lambda df: tables.append(1) or df.localCheckpoint())
    patches = spark.createDataFrame(rows, "tenant_id string, fact_id string, superseded_by string")
    for order, most in (("near", 7), ("dealt", 31)):
        tables.clear()
        p = patches.coalesce(1) if order == "near" else patches.repartition(7, "fact_id")
        got = {r.fact_id: r.current_id for r in fct.follow_supersession(p).collect()}
        assert len(tables) <= most
        assert got == {f"f{i}": f"f{600 + i % 2}" for i in range(600)} | {"a": None, "b": None, "c": None, "n": None}


def test_hot_contradiction_group_is_counted_not_paired(spark):
    facts = spark.range(2000).select(F.lit("t").alias("tenant_id"), F.lit("s").alias("subject_entity"),
                                     F.lit("p").alias("predicate"), (F.col("id") % 5).cast("string").alias("object_value"))
    row = fct.contradiction_groups(facts).first()
    assert (row.n_facts, row.n_objects, row.n_pairs) == (2000, 5, (2000 * 2000 - 5 * 400 * 400) // 2)


def test_supersession_cycle_has_no_end(spark):
    p = spark.createDataFrame([("t", "a", "b"), ("t", "b", "c"), ("t", "x", "y"), ("t", "y", "x"), ("t", "z", "x")],
                              "tenant_id string, fact_id string, superseded_by string")
    got = {r.fact_id: r.current_id for r in fct.follow_supersession(p).collect()}
    assert got == {"a": "c", "b": "c", "x": None, "y": None, "z": None}


def test_relation_names(spark):
    for raw, want in {"depends on": "depends_on", "fixed-by": "fixed_by", "unknown relation": "related_to", "???": "related_to"}.items():
        assert spark.range(1).select(normalize_relation(F.lit(raw)).alias("x")).first().x == want


def test_response_shapes(spark):
    good = '{"facts":[{"subject":"s","source_span_index":[0,7]}],"entities":[]}'
    shapes = {good: 1, f"```json\n{good}\n```": 1, f"Sure: {good} done": 1, good.replace("}]", "},]"): 1, "no {": None}
    for text, want in shapes.items():
        row = spark.createDataFrame([(text,)], "x string").select(rs.parse(F.col("x"), rs.EXTRACT_SCHEMA).alias("r")).first()
        assert (len(row.r.facts) if row.r else None) == want, text


def test_similar_names_equal_brute_force(spark):
    names = [f"customer#{i:06d}" for i in range(60)] + ["small ring", "small rings", "smal ring", "blue gear", "blue gears", "x", "ab"]
    df = spark.createDataFrame([("t", "b", n) for n in names], "tenant_id string, name_block string, name string")
    got = {(r.left_name, r.right_name) for r in similar_names(df, df, ["tenant_id", "name_block"]).collect()}
    want = {(a, b) for a in names for b in names if a != b and SequenceMatcher(None, a, b).ratio() > 0.92}
    assert got == want


def test_containment_equals_brute_force_both_ways(spark):
    needles = ["alphabet", "gear", "ab", "z", "预算", "customer#1", "customer#12"]
    hays = ["the alphabet", "geared up", "cab z", "年度预算表", "customer#12 and", "none"]
    n = spark.createDataFrame([("t", x) for x in needles], "tenant_id string, needle string")
    h = spark.createDataFrame([("t", str(i), x) for i, x in enumerate(hays)], "tenant_id string, id string, hay string")
    want = {(str(i), x) for x in needles for i, y in enumerate(hays) if x in y}
    for limit in (1000, 0):
        assert {(r.id, r.needle) for r in containment_join(n, h, "id", limit).collect()} == want


def test_components_and_cycles(spark):
    pairs = spark.createDataFrame([("t", f"n{i:02d}", f"n{i + 1:02d}") for i in range(12)] + [("t", "x", "y")],
                                  "tenant_id string, a string, b string")
    comp = {r.node: r.component for r in ent.connected_components(pairs).collect()}
    assert set(comp.values()) == {"n00", "x"} and len(comp) == 15
    edges = spark.createDataFrame(
        [("t", s, "depends_on", t) for s, t in [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("g", "a")]],
        "tenant_id string, source_entity string, relation_type string, target_entity string")
    assert {r.entity_id for r in graph.cycle_nodes(edges).collect()} == {"a", "b", "c", "e", "f"}


def test_fusion_prefers_agreement_and_ignores_partitioning(spark):
    rows = [("t", "q", s, r) for r, s in enumerate("abc", 1)], [("t", "q", s, r) for r, s in enumerate("bad", 1)]
    a, b = (spark.createDataFrame(x, "tenant_id string, qid string, span_id string, rank int") for x in rows)
    one = [tuple(r) for r in ret.fuse([a, b]).orderBy("rank").select("span_id", "rank").collect()]
    many = [tuple(r) for r in ret.fuse([a.repartition(16), b.repartition(3)]).orderBy("rank").select("span_id", "rank").collect()]
    assert one == many and one[0][0] in "ab"


def test_claim_verification(spark):
    answers = spark.createDataFrame([("t", "a", "One [doc1:sp1]. Two [doc2:sp2]. Three.")], "tenant_id string, answer_id string, answer string")
    spans = spark.createDataFrame([("t", "doc1", "sp1"), ("t", "doc2", "sp2")], "tenant_id string, document_id string, span_id string")
    rows = ev.split_claims(answers)
    scores = ev.cited_spans(rows).select("tenant_id", "answer_id", "claim_no", "span_id", F.lit(True).alias("entailed"), F.lit(0.9).alias("score"))
    done = ev.verify_claims(rows, spans, scores)
    assert [r.verified for r in done.orderBy("claim_no").collect()] == [True, True, None]
    assert ev.verify_answers(done).first().verified_ratio == 1.0


def test_empty_graph(spark):
    e = spark.createDataFrame([], "tenant_id string, entity_id string, name string, type string")
    r = spark.createDataFrame([], "tenant_id string, relation_id string, source_entity string, relation_type string, target_entity string")
    assert mnt.orphans(e, r).count() == 0 and graph.degrees(e, r).count() == 0


def test_vector_blocks_equal_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 8))
    v[60:] = v[:60] + 0.1 * rng.normal(size=(60, 8))
    rows = [("t", "n" if i < 60 else "n", f"e{i:03d}", "x", [float(a) for a in v[i]]) for i in range(120)]
    df = spark.createDataFrame(rows, "tenant_id string, name string, entity_id string, type string, embedding array<double>").repartition(5)
    got = {(r.entity_id, r.canonical_id) for r in ent.embedding_matches(df, df, 0.85, 200).collect()}
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    i, j = np.nonzero(u @ u.T > 0.85)
    assert got == {(f"e{a:03d}", f"e{b:03d}") for a, b in zip(i, j)}


def test_single_sighting_keeps_its_confidence(spark):
    s = spark.createDataFrame([("t", "a", "owns", "b", 1.0, 1), ("t", "a", "owns", "c", 1.0, 1), ("t", "a", "owns", "c", 2.0, 2)],
                              "tenant_id string, source_entity string, relation_type string, target_entity string, seen_at double, seq int")
    assert {r.target_entity: r.confidence for r in graph.merge_sightings(s).collect()} == {"b": 1.0, "c": pytest.approx(2 / 3)}
    said = s.withColumn("confidence", F.lit(0.25))
    first = graph.merge_sightings(said)
    assert {r.target_entity: r.confidence for r in first.collect()} == {"b": 0.25, "c": pytest.approx(2 / 3)}
    again = graph.merge_sightings(said.filter("target_entity = 'b'"), first)
    assert {r.target_entity: (r.source_count, r.confidence) for r in again.collect()} == {
        "b": (2, pytest.approx(2 / 3)), "c": (2, pytest.approx(2 / 3))}


def test_edge_limit_holds_per_tenant(spark):
    e = spark.createDataFrame([(t, f"r{i}", "owns", "x", "y") for t in "ab" for i in range(5)],
                              "tenant_id string, relation_id string, relation_type string, source_entity string, target_entity string")
    got = [(r.tenant_id, r.relation_id) for r in graph.typed_edges(e, ["OWNS"], limit=3).collect()]
    assert sorted(got) == [(t, f"r{i}") for t in "ab" for i in range(3)]


def test_repeated_patches_and_actions_add_no_rows(spark):
    f = spark.createDataFrame([("t", "f1", "inferred", False, 1.0), ("t", "f2", "inferred", True, 1.0)],
                              "tenant_id string, fact_id string, provenance string, stale boolean, last_confirmed double")
    p = spark.createDataFrame([("t", "f1", "a", 1), ("t", "f1", "b", 2)], "tenant_id string, fact_id string, superseded_by string, seq int")
    got = sorted((r.fact_id, r.superseded_by, r.stale) for r in fct.apply_patches(f, p.filter("seq < 3")).collect())
    assert got == [("f1", "b", True), ("f2", None, True)]
    a = p.withColumn("action", F.when(F.col("seq") == 2, "confirm").otherwise("reject"))
    after = {r.fact_id: (r.provenance, r.stale) for r in fct.apply_review(f, a, 9.0)[0].collect()}
    assert after == {"f1": ("extracted", False), "f2": ("inferred", True)}


def test_cycles_beside_a_long_chain(spark):
    kind = graph.ACYCLIC_TYPES[0]
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(300)]
    ring = [(f"r{i}", f"r{(i + 1) % 40}") for i in range(40)]
    rows = chain + ring + [("n100", "x1"), ("x1", "x2"), ("x2", "n090"), ("r5", "n000"), ("l", "l"), ("n300", "l"), ("p", "q"), ("q", "p"), ("p", "q2"), ("q2", "q3"), ("q3", "p")]
    e = spark.createDataFrame([("t", kind, a, b) for a, b in rows], "tenant_id string, relation_type string, source_entity string, target_entity string")
    want = {f"r{i}" for i in range(40)} | {f"n{i:03}" for i in range(90, 101)} | {"x1", "x2", "l", "p", "q", "q2", "q3"}
    got = [r.entity_id for r in graph.cycle_nodes(e, [kind], max_rounds=12).collect()]
    assert sorted(got) == sorted(want)
