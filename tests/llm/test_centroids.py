"""Centroid clustering against brute force."""

import hashlib
import math
import random

import pytest

from sparklore.llm import centroids


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(64 * x) < 2 ** 27 for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else c0 for j, c0 in enumerate(cs)]
    placed = [(i, *near(v)) for i, v in kept]
    own = {}
    for _, d, c in placed:
        own[c] = own.get(c, 0) + d
    return [(i, c, d, own[c], sum(own.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, d, c in placed]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("most", [200_000, 3])
@pytest.mark.parametrize("k, dims", [(4, 6), (16, 3)])
def test_equal_to_brute_force(spark, monkeypatch, most, k, dims):
    monkeypatch.setattr(centroids.occurring, "__defaults__", (most,))
    monkeypatch.setattr(centroids, "SLICE", 7)
    rng = random.Random(k)
    rows = [(i, [float(rng.choice([0, 0, rng.uniform(-1, 1), rng.uniform(-50, 50)])) for _ in range(dims)]) for i in range(120)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None), (201, []), (202, [0.0] * (dims + 1)), (203, [nan] * dims), (204, [inf] * dims), (205, [None] * dims),
             (206, [1e30] * dims), (207, [2e6] * dims), (None, [0.5] * dims), (7, rows[7][1]), (8, rows[9][1]), (None, [0.5] * dims)]
    rows += [(300 + i, [0.25] * dims) for i in range(60)]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string")
    got = [tuple(r) for r in centroids.cluster(table, k=k, dimensions=dims).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, k, 3, dims), key=key)


def test_small_tables(spark):
    table = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 1.0])], "vec_id long, embedding array<float>")
    got = centroids.cluster(table, dimensions=2).collect()
    assert sorted((r["vec_id"], r["distance"], r["inertia"]) for r in got) == [(1, 0, 0), (2, 0, 0)]
    assert len({r["cluster"] for r in got}) == 2
    for none in (table.limit(0), table):        # no rows; no vector of 64 components
        out = centroids.cluster(none)
        assert out.collect() == [] and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
