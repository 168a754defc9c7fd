"""Stored adjacency and vector blocks against plain walks and plain sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklore.operators import graph
from sparklore.operators import retrieval as ret
from sparklore.sources.adjacency import Adjacency
from sparklore.sources.vector_index import VectorIndex

EDGES = ("relation_id string, tenant_id string, source_entity string, relation_type string, target_entity string, "
         "source_count long, confidence double")


def test_neighborhood_of_stored_edges(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"r{i}", f"t{i % 2}", f"n{rng.randrange(60)}", "owns", f"n{rng.randrange(60)}", 1, 1.0) for i in range(90)]
    edges = spark.createDataFrame(rows, EDGES)
    adj = Adjacency(spark, str(tmp_path), 4)
    adj.extend(edges.filter("relation_id < 'r5'"), 0)
    adj.extend(edges.filter("relation_id >= 'r5'"), 1)
    seeds = spark.createDataFrame([("t0", "n1", "q1"), ("t0", "n2", "q2"), ("t1", "n1", "q3"), ("t1", "nowhere", "q4")],
                                  "tenant_id string, entity_id string, qid string")
    for hops in (1, 3):
        for mine, plain in zip(adj.neighborhood(seeds, hops), graph.neighborhood(edges, seeds, hops)):
            assert sorted(map(str, mine.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    adj.log.compact()
    plan = adj.touching(seeds)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan     # the edges stay where they are
    changed = edges.filter("relation_id = 'r7'").withColumn("source_count", F.lit(5).cast("long"))
    adj.extend(changed, 2)
    ends = [(r.source_entity, r.target_entity) for r in changed.collect()]
    again = adj.neighborhood(spark.createDataFrame([("t1", ends[0][0])], "tenant_id string, entity_id string"))[1]
    assert [r.source_count for r in again.filter("relation_id = 'r7'").collect()] == [5]


@pytest.mark.parametrize("rows", [1024, 16])
def test_search_opens_few_blocks_and_is_exact(spark, tmp_path, rows):
    rng = np.random.default_rng(2)
    centers = rng.choice([-1.0, 1.0], (12, 16))
    x = (centers[rng.integers(0, 12, 1500)] + 0.1 * rng.standard_normal((1500, 16)))
    items = [("t", f"s{i:04d}", v) for i, v in enumerate(x.tolist())] + [("t", "zero", [0.0] * 16), ("t", "none", None), ("u", "s0000", x[0].tolist()), ("t", "short", [1.0, 2.0])]
    items += [("t", f"same{i}", x[5].tolist()) for i in range(30)]
    spans = spark.createDataFrame(items, "tenant_id string, span_id string, embedding array<double>")
    asked = [("t", f"q{i}", x[i * 7].tolist()) for i in range(20)] + [("t", "q5same", x[5].tolist()), ("u", "qu", x[3].tolist()), ("t", "qnone", None), ("t", "qzero", [0.0] * 16)]
    questions = spark.createDataFrame(asked, "tenant_id string, qid string, vector array<double>")
    index = VectorIndex(spark, str(tmp_path), 4)
    index.extend(spans.filter("span_id < 's0700'"), "span_id", "embedding", 0, rows)
    index.extend(spans.filter("span_id >= 's0700'"), "span_id", "embedding", 1, rows)
    got = ret.vector_search(questions, index, 10)
    plain = ret.vector_stream(questions.filter("vector IS NOT NULL"), spans, 10)
    assert sorted(tuple(r) for r in got.select("tenant_id", "qid", "span_id", "rank", F.round("score", 9)).collect()) == sorted(
        tuple(r) for r in plain.select("tenant_id", "qid", "span_id", "rank", F.round("score", 9)).collect())
    _, first, second = index.search(questions, 10)
    opened, blocks = first.count() + second.count(), index.log.read().filter("tenant_id = 't' AND dim = 16").count()
    assert opened < 0.7 * 21 * blocks, (opened, blocks)     # of all pairs of a question and a block
