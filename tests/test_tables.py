"""Purges by folder, scorers of text pairs, contradiction requests, page spans."""

import glob
import json
import os

from pyspark.sql import functions as F

from sparklore.functions.scorers import pair_scorer
from sparklore.operators import facts as fct
from sparklore.operators import governance as gov
from sparklore.operators import wiki
from sparklore.sources import corpus


def test_purge_leaves_other_tenants_files(spark, tmp_path):
    rows = [(t, f"{t}{i}", i) for t in ("a", "b", "c") for i in range(5)]
    for name in ("facts", "spans"):
        corpus.write_by_tenant(spark.createDataFrame(rows, "tenant_id string, id string, v int"), f"{tmp_path}/{name}")

    def files(tenant):
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/*/tenant_id={tenant}/*.parquet")}
    before = files("a") | files("c")
    tenants = spark.createDataFrame([(t, "active") for t in "abc"], "tenant_id string, status string")
    gone = tenants.filter("tenant_id = 'b'")
    status, audit = gov.purge_tables(str(tmp_path), ["facts", "spans"], tenants, gone, 5.0)
    assert {tuple(r) for r in status.collect()} == {("a", "active"), ("b", "suspended"), ("c", "active")}
    assert {(r.tenant_id, r.action, r.target, r.n_rows, r.ts) for r in audit.collect()} == {("b", "purge", t, 5, 5.0) for t in ("facts", "spans")}
    assert files("a") | files("c") == before
    for name in ("facts", "spans"):
        table = spark.read.parquet(f"{tmp_path}/{name}")
        assert table.columns == ["id", "v", "tenant_id"] and {r.tenant_id for r in table.collect()} == {"a", "c"}
    again = gov.purge_tables(str(tmp_path), ["facts", "spans"], status, gone, 6.0)[1]
    assert again.collect() == []


def test_scorer_is_loaded_once_per_task_and_gets_bounded_lists(spark):
    def load():
        calls = []

        def model(left, right):
            calls.append(len(left))
            assert len(left) <= 3
            return [float(len(a) + 10 * len(b) + 1000 * (len(calls) > 1)) for a, b in zip(left, right)]
        return model
    rows = [("x" * (i % 4), "y" * (i % 3)) for i in range(10)] + [(None, "y"), ("x", None)]
    df = spark.createDataFrame(rows, "a string, b string").coalesce(1)
    got = df.select("a", "b", pair_scorer(load, rows=3)("a", "b").alias("s")).collect()
    assert [r.s is None for r in got] == [a is None or b is None for a, b in rows]
    assert [r.s for r in got][:10] == [len(a) + 10 * len(b) + 1000 * (i >= 3) for i, (a, b) in enumerate(rows[:10])]
    assert df.limit(0).select(pair_scorer(load)("a", "b")).collect() == []


def test_contradictions_are_asked_by_value(spark):
    rows = [("t", f"f{i}", "S" if i % 2 else "s", "P", v) for i, v in enumerate(["x"] * 50 + [" X "] * 5 + ["y"] * 50 + ["z"])]
    facts = spark.createDataFrame(rows + [("t", "g", "other", "p", "x")], "tenant_id string, fact_id string, subject_entity string, predicate string, object_value string")
    asked = fct.contradiction_requests(facts).collect()
    assert {(r.value_a, r.value_b) for r in asked} == {("x", "y"), ("x", "z"), ("y", "z")}
    assert json.loads(asked[0].request).keys() == {"subject", "predicate", "value_a", "value_b"}
    answers = fct.contradiction_requests(facts).withColumn("response", F.when(F.col("value_b") == "z", "no idea").otherwise('{"contradict": true}'))
    assert [(r.value_a, r.value_b) for r in fct.contradiction_verdicts(answers).collect()] == [("x", "y")]


def test_two_spans_per_line(spark):
    e = spark.createDataFrame([("t", "e", "E", "org")], "tenant_id string, entity_id string, name string, type string")
    f = spark.createDataFrame([("t", "f1", "e", "p", "o", "extracted", "s0"), ("t", "f2", "e", "p", "q", "ambiguous", None)],
                              "tenant_id string, fact_id string, subject_entity string, predicate string, object_value string, provenance string, span_id string")
    edges = spark.createDataFrame([], "tenant_id string, relation_id string, source_entity string, relation_type string, target_entity string")
    links = spark.createDataFrame([("t", "f1", f"s{i}", i) for i in (3, 1, 2)], "tenant_id string, fact_id string, span_id string, pos int")
    page = wiki.page_sources(e, f, edges, links).first()["content"]
    assert page == "E (org)\n\n- e p o [span:s1,s2]\n- e p q [span:] !conflict\n\n"
    assert "[span:s0]" in wiki.page_sources(e, f, edges).first()["content"]


def test_pages_rank_facts_once_and_meet_their_spans_once(spark):
    entities = spark.createDataFrame([("t", "e", "E", "org")], "tenant_id string, entity_id string, name string, type string")
    facts = spark.createDataFrame([("t", f"f{i:03}", "e", "p", "x", "extracted") for i in range(70)],
                                  "tenant_id string, fact_id string, subject_entity string, predicate string, object_value string, provenance string")
    spans = spark.createDataFrame([("t", f"f{i:03}", f"s{j}", j) for i in range(70) for j in range(i % 4)],
                                  "tenant_id string, fact_id string, span_id string, pos int")
    edges = spark.createDataFrame([], "tenant_id string, relation_id string, source_entity string, relation_type string, target_entity string")
    pages = wiki.page_sources(entities, facts, edges, spans)
    lines = [f"- e p x [span:{','.join(f's{j}' for j in range(min(i % 4, 2)))}]" for i in range(60)]
    assert pages.first()["content"] == "E (org)\n\n" + "\n".join(lines) + "\n\n"
    assert "LeftSemi" not in pages.select("*")._jdf.queryExecution().executedPlan().toString()
