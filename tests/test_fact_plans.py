"""How often facts move: plans of operators on the fact table."""

from pyspark.sql import functions as F

from sparklore.operators import facts as fct
from sparklore.operators import governance as gov
from sparklore.session import settings
from sparklore.sources import corpus

FACTS = "tenant_id string, fact_id string, subject_entity string, predicate string, object_value string"


def test_requests_move_the_facts_once(spark):
    rows = [("t", "f1", "A", "is", "x"), ("t", "f2", "a", "IS", " X"), ("t", "f3", "a", "is", "y"), ("t", "f4", "a", "is", "z"),
            ("u", "f5", "a", "is", "q"), (None, "f6", "a", "is", "x"), (None, "f7", "a", "is", "y")]
    out = fct.contradiction_requests(spark.createDataFrame(rows, FACTS))
    assert sorted((r.tenant_id, r.value_a, r.value_b) for r in out.collect()) == [("t", "x", "y"), ("t", "x", "z"), ("t", "y", "z")]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 2     # both sides of the pairs; when run, the second is the first one again


def test_rows_are_not_dealt_by_tenant_to_be_purged(spark):
    rows = spark.createDataFrame([(t, f"f{i}") for i, t in enumerate(["t0", "t1", "t2", "t0", None])], "tenant_id string, fact_id string")
    tenants = spark.createDataFrame([("t0", "suspended"), ("t0", "suspended"), ("t1", "active"), ("t2", "active"), ("t9", "active")],
                                    "tenant_id string, status string")
    gone = tenants.groupBy("tenant_id").agg(F.max("status").alias("status")).filter("status = 'suspended'")
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):      # as for lists whose size is not known before they are made
        for bound, moves in ((10, False), (0, True)):
            for out, want in ((gov.purge(rows, gone, bound), ["f1", "f2", "f4"]), (gov.only_active(rows, tenants, bound), ["f1", "f2"])):
                plan = out._jdf.queryExecution().executedPlan().toString()
                assert ("hashpartitioning" in plan) == moves and sorted(r.fact_id for r in out.collect()) == want


def test_tenants_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    rows = spark.range(400).selectExpr("'t' || (id % 4) AS tenant_id", "id").coalesce(1)
    seen = {}
    for name, bound in (("few", corpus.OPEN_TENANTS), ("many", 2)):
        monkeypatch.setattr(corpus, "OPEN_TENANTS", bound)
        before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
        corpus.write_by_tenant(rows, f"{tmp_path}/{name}")
        assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
        back = spark.read.parquet(f"{tmp_path}/{name}").select("tenant_id", "id", "_metadata.file_path").collect()
        assert {(r.tenant_id, r.id) for r in back} == {(f"t{i % 4}", i) for i in range(400)} and len(back) == 400
        seen[name] = {r.file_path for r in back}
    assert len(seen["few"]) == 4 and all(p.endswith(".zstd.parquet") for p in seen["few"])


def test_arrivals_move_before_they_are_folded(spark):
    schema = "tenant_id string, fact_id string, object_value string, source_count long, last_confirmed double, retention double"
    base = spark.createDataFrame([("t", "f1", "x", 2, 1.0, 0.5), ("t", "f2", "y", 1, 1.0, 0.5)], schema)
    came = spark.createDataFrame([("t", "f1", "z", 1, 1.0, 0.5, "a"), ("t", "f3", "p", 4, 1.0, 0.5, "a"), ("t", "f3", "q", 9, 1.0, 0.5, "b")],
                                 schema + ", seq string")
    out = fct.upsert_by_id(base, came, 7.0)
    assert sorted((r.fact_id, r.object_value, r.source_count, r.last_confirmed) for r in out.collect()) == [
        ("f1", "z", 3, 7.0), ("f2", "y", 1, 1.0), ("f3", "q", 5, 7.0)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 2 and "REPARTITION_BY_COL" in plan
