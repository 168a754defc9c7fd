"""Plans of entity operators that decide what is moved and sorted."""

from sparklore.operators import entities as ent


def test_upsert_deals_arrivals_before_it_folds_them(spark):
    base = spark.createDataFrame([("t", "e1", "One", "product", "old")], "tenant_id string, entity_id string, name string, type string, description string")
    came = spark.createDataFrame(
        [("t", "e1", "b", "Uno", "thing", ""), ("t", "e1", "a", "Un", "thing", "new"), ("t", "e2", "b", "late", "thing", "x"),
         ("t", "e2", "a", None, "early", None), ("t", "e2", "c", "later", "org", "")],
        "tenant_id string, entity_id string, seq string, name string, type string, description string")
    out = ent.upsert_entities(base, came)
    assert sorted(map(tuple, out.collect())) == [("t", "e1", "One", "product", "new"), ("t", "e2", None, "early", "x")]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_min_by") < plan.index("REPARTITION_BY_COL")
