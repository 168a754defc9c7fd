"""SimHash near-duplicates against brute force."""

import random
import re

import pytest
import xxhash

from sparklore.llm import simhash

SCHEMA = "doc_id long, text string, lang string, fp string, root string, z string"


def brute_fingerprint(text, words=3):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_roots(values):
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("text", ["", " \n", "a", "A b", "a B c", "é ñ ñ É x", "a\x0bb\x85c d", "the same " * 50, None])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == signed(brute_fingerprint(text))


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_equal_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(crowd)
    values = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 4, 40])):
            v = base
            for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 3, 4, 5, 6])):
                v ^= 1 << b
            values.add(signed(v))
    values |= {0, -1, 7, signed(1 << 63)}
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r["fp"]: r["root"] for r in simhash.links(nodes).collect()}
    assert got == brute_roots(values)


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (90, 95), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 90, 90: 90, 95: 90}


def test_documents(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, base), (3, base.upper()), (9, base + " ."), (7, "other words here now"), (8, None), (2, ""), (4, " \t"),
            (7, "other words here now"), (None, "only this"), (None, "only this")]
    docs = spark.createDataFrame([(i, t, "en", "x", "y", "z") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in simhash.component_ids(docs).collect()), key=repr)
    fps = [signed(brute_fingerprint(t)) for _, t in rows]
    roots, least = brute_roots(fps), {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], i), i)
    want = sorted(((i, f"{f & (1 << 64) - 1:016x}", least.get(roots[f])) for (i, _), f in zip(rows, fps)), key=repr)
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == sorted(
        {least.get(r) or -1 for r in (roots[f] for f in fps)})
    assert simhash.component_ids(docs.limit(0)).collect() == []
    assert simhash.keep_one(docs.limit(0)).collect() == []


def test_variants_are_not_broadcast(spark, monkeypatch):
    plans, whole = [], simhash.components

    def seen(edges):
        plans.append(edges._jdf.queryExecution().executedPlan().toString())
        return whole(edges)

    monkeypatch.setattr(simhash, "components", seen)
    monkeypatch.setattr(simhash, "CROWD", 2)
    rng = random.Random(5)
    values = {0}
    for _ in range(40):
        v = 0
        for b in rng.sample(range(32), rng.choice([3, 4, 5, 6])):
            v ^= 1 << b
        values.add(v)
    got = {r["fp"]: r["root"] for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    assert got == brute_roots(values)
    # Spark takes a fingerprint's 64 or 2,016 variants to be as large as the fingerprint.
    assert re.search(r"SortMergeJoin \[z#", plans[-1]) and not re.search(r"BroadcastHashJoin \[z#", plans[-1])
