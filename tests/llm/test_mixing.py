"""Mixing against a plain water-filling."""

import re
from collections import defaultdict

import pytest

from sparklore.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, h string, d0 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "w") for i, t, s in rows], SCHEMA)


def brute_targets(sizes, weights, epochs=3):
    total, fixed = sum(sizes.values()), {s for s in sizes if not sizes[s]}
    while True:
        rest = total - sum(epochs * sizes[s] for s in fixed)
        weight = sum(weights[s] for s in sizes if s not in fixed)
        share = {s: epochs * sizes[s] if s in fixed else rest * weights[s] / weight for s in sizes}
        above = {s for s in sizes if s not in fixed and share[s] > epochs * sizes[s] + 1e-9}
        if not above:
            return share
        fixed |= above


@pytest.fixture(scope="module")
def rows():
    out, n = [], 0
    for source, count in [("a", 5), ("b", 900), ("B", 60), ("é", 300), (None, 40), ("empty", 3), ("z", 1)]:
        for i in range(count):
            out.append((n, None if source == "empty" else ("w " * (1 + n * 7 % 23)) + "\tend\x0b", source))
            n += 1
    return out + [out[10], (None, "no id", "b"), (7_000, "", "b"), (7_001, "x\x85y　z", "b")]


def test_mix(spark, rows):
    mixed = mixing.mix(docs(spark, rows))
    assert {"d0", "h"} <= set(mixed.columns)
    got = mixed.collect()
    assert len(got) == len(rows) and {r["d0"] for r in got} == {"w"}
    words = defaultdict(list)
    for i, t, s in rows:
        words[i, s].append(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] in words[r["doc_id"], r["source"]] and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    want = brute_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s], s
        # What is left is less than any document that could still be taken, but for rows that are taken alike.
        least = min((r["size"] for r in got if r["source"] == s and r["size"] and r["copies"] == min(x["copies"] for x in got if x["source"] == s)), default=0)
        assert want[s] - taken[s] < max(1, 2 * least), s
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_large_documents_at_the_border_are_passed_by(spark):
    rows = [(i, "w " * (4000 if i % 3 == 0 else 3), s) for s in "abcd" for i in range(ord(s) * 1000, ord(s) * 1000 + 200)]
    got = mixing.mix(docs(spark, rows)).collect()
    for s in "abcd":
        of = [r for r in got if r["source"] == s]
        whole = min(r["copies"] for r in of)
        left = of[0]["target"] - sum(r["taken"] for r in of)
        assert 0 <= left < min((r["size"] for r in of if r["copies"] == whole), default=1), s     # nothing that fits is open


def test_repeated(spark, rows):
    mixed = mixing.mix(docs(spark, rows))
    out = mixing.repeated(mixed, ["doc_id", "text", "source"])
    assert out.count() == sum(r["copies"] for r in mixed.collect())


@pytest.mark.parametrize("sizes", [{}, {"a": 0, "b": 0}, {"a": 10}, {"a": 1, "b": 1, "c": 1000}, {"a": 1, "b": 50, "c": 1, "d": 3, "e": 900}])
def test_targets(spark, sizes):
    weights = {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(sizes)}
    table = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size long, weight double")
    got = {r["source"]: r["target"] for r in mixing.targets(table).collect()}
    assert got == pytest.approx(brute_targets(sizes, weights) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0))


def test_numbered_over_many_ranges(spark):
    names = [f"s{i:03}" for i in range(300)]
    table = spark.createDataFrame([(n,) for n in [*names[::-1], None]], "source string")
    got = {r["source"]: r["ordinal"] for r in mixing.numbered(table).collect()}
    assert got == {**{n: i for i, n in enumerate(names)}, None: 300}


def test_no_rows(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    assert mixing.mix(docs(spark, [(1, None, None)])).collect()[0]["taken"] == 0
