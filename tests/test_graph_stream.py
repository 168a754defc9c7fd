"""The graph stream and entity linking against brute force, with a hub that most questions ask for."""

import random

from sparklore.operators import entities as ent
from sparklore.operators import retrieval as ret

Q = "tenant_id string, qid string, question string, vector array<double>"
E = "tenant_id string, entity_id string, name string, document_id string, embedding array<double>"
R = "tenant_id string, relation_id string, source_entity string, target_entity string, confidence double"


def tables(spark):
    rnd = random.Random(11)
    names = [f"n{i}" for i in range(30)]
    vector = {n: [rnd.gauss(0, 1) for _ in range(6)] for n in names}
    entities = [("t", n, f"Name {n} of it", "d", vector[n]) for n in names] + [("u", "n0", "Other", "d", vector["n0"])]
    questions = [("t", f"q{i}", f"name n{i} of" if i % 3 else "nothing", vector[names[i % 2]] if i % 4 else [0.0] * 6) for i in range(12)]
    edges = [("t", f"r{i}", "n0" if i % 2 else rnd.choice(names), rnd.choice(names), rnd.randint(1, 9) / 10) for i in range(200)]
    edges.append(("u", "r0", "n0", "n0", 0.9))
    cited = [("t", f"r{rnd.randrange(200)}", f"s{rnd.randrange(90)}") for _ in range(500)] + [("u", "r0", "s0")]
    spans = [("t", f"s{i}") for i in range(80)]        # s80 to s89 are gone
    return (spark.createDataFrame(questions, Q), spark.createDataFrame(entities, E), spark.createDataFrame(edges, R),
            spark.createDataFrame(cited, "tenant_id string, relation_id string, span_id string"),
            spark.createDataFrame(spans, "tenant_id string, span_id string"), edges, cited)


def test_graph_stream(spark):
    questions, entities, edges, cited, spans, edge_rows, cited_rows = tables(spark)
    linked = [(r.tenant_id, r.qid, r.entity_id, r.sim) for r in ent.link_entities(questions, entities).collect()]
    assert len({x[:3] for x in linked}) == len(linked)          # an entity found by vector and by name stands once
    named = {(f"q{i}", f"n{i}") for i in range(12) if i % 3}
    assert named <= {x[1:3] for x in linked}
    by_vector = {x[1:3] for x in linked if x[3] < 1 - 1e-9}
    assert by_vector and {q for q, _ in by_vector}.isdisjoint({"q0", "q4", "q8"})     # zero vectors find nothing
    for k in (3, 50):
        want = []
        for qid in {x[1] for x in linked}:
            mine, score = {x[2] for x in linked if x[1] == qid}, {}
            for _, rid, source, target, confidence in edge_rows[:-1]:
                if source in mine or target in mine:
                    for _, _, span in (c for c in cited_rows[:-1] if c[1] == rid):
                        if int(span[1:]) < 80:
                            score[span] = max(score.get(span, 0), confidence)
            best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
            want += [(qid, s, i + 1, c) for i, (s, c) in enumerate(best)]
        got = ret.graph_stream(questions, spans, entities, edges, cited, k)
        assert sorted((r.qid, r.span_id, r["rank"], r.score) for r in got.collect()) == sorted(want)
