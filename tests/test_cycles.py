"""Nodes on cycles against strongly connected parts by brute force."""

import random

import pytest

from sparklore.operators import graph

SCHEMA = "tenant_id string, relation_type string, source_entity string, target_entity string"


def brute(edges):
    """Nodes that reach themselves."""
    out, adj = set(), {}
    for t, k, a, b in edges:
        adj.setdefault((t, k, a), set()).add((t, k, b))
    for start in adj:
        seen, todo = set(), list(adj[start])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += adj.get(n, ())
        if start in seen:
            out.add(start)
    return out


def check(spark, edges, **kw):
    got = [tuple(r) for r in graph.cycle_nodes(spark.createDataFrame(edges, SCHEMA), **kw).select("tenant_id", "relation_type", "entity_id").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", [0, 1])
def test_equal_to_brute_force(spark, seed):
    rng, edges = random.Random(seed), []
    for t, n, m in (("a", 40, 50), ("b", 60, 55), ("c", 25, 60)):       # sparse, broken, dense
        edges += [(t, rng.choice(["depends_on", "caused_by"]), f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
    ring = [("r", "depends_on", f"x{i}", f"x{(i + 1) % 9}") for i in range(9)]
    edges += ring + [("r", "depends_on", "x3", "tail"), ("r", "depends_on", "tail", "end"), ("r", "depends_on", "in", "y1"), ("r", "depends_on", "y1", "y1")]
    edges += [("d", "depends_on", f"{c}{i}", f"{c}{(i + 1) % 4}") for c in "pq" for i in range(4)] + [("d", "depends_on", "p0", "q0"), ("d", "depends_on", "q2", "out")]
    assert check(spark, edges) == brute(edges)


def test_long_ladder_with_a_cycle_in_few_rounds(spark):
    n = 40
    rails = [("t", "depends_on", f"{c}{i:05d}", f"{c}{i + 1:05d}") for c in "uv" for i in range(n)]
    rungs = [("t", "depends_on", f"u{i:05d}", f"v{i:05d}") for i in range(n + 1)]
    ladder = rails + rungs
    assert check(spark, ladder, max_rounds=8) == set()
    closed = ladder + [("t", "depends_on", f"v{n:05d}", "u00010"), ("t", "depends_on", "u00005", "side"), ("t", "depends_on", "side", "deep")]
    want = {("t", "depends_on", f"u{i:05d}") for i in range(10, n + 1)} | {("t", "depends_on", f"v{i:05d}") for i in range(10, n + 1)}
    assert check(spark, closed, max_rounds=8) == want
