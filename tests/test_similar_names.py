"""Numbered names meet on what is left without one character; all lengths equal brute force."""

import random
from difflib import SequenceMatcher

import pytest

from sparklore.functions import similarity
from sparklore.functions.similarity import first_similar, similar_names
from sparklore.operators import entities as ent


def names(seed):
    rng = random.Random(seed)
    out = {f"customer#{i:09d}" for i in range(0, 900, 11)} | {f"customer#{i:08d}" for i in range(0, 300, 13)}
    out |= {"".join(rng.choices("ab", k=rng.choice([1, 2, 12, 13, 14]))) for _ in range(40)}
    for base in ["antique lace blue steel gear", "Zürich 预算 report of the year"]:
        for _ in range(15):
            cut = sorted(rng.sample(range(len(base)), rng.choice([1, 2, 3])), reverse=True)
            word = base.lower()
            for c in cut:
                word = word[:c] + rng.choice(["", "x"]) + word[c + 1:]
            out.add(word)
    return sorted(out)


@pytest.mark.parametrize("threshold", [0.92, 0.85])
def test_every_length_equals_brute_force(spark, threshold):
    a, b = names(1), names(2)
    left, right = (spark.createDataFrame([("t", n) for n in x] + [("u", x[0])], "tenant_id string, name string") for x in (a, b))
    rows = [(r.left_name, r.right_name) for r in similar_names(left, right, ["tenant_id"], threshold).filter("tenant_id = 't'").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(x, y) for x in a for y in b if x != y and SequenceMatcher(None, x, y).ratio() > threshold}


def test_numbered_names_do_not_meet_on_bigrams(spark):
    df = spark.createDataFrame([("t", f"customer#{i:09d}") for i in range(300)], "tenant_id string, name string")
    out = similar_names(df, df, ["tenant_id"])
    plan = out._jdf.queryExecution()
    assert out.filter("left_name = 'customer#000000123'").count() >= 9 * 2
    assert "array_distinct(transform(sequence(1, length(" in plan.optimizedPlan().toString()


def test_matches_are_those_of_all_pairs(spark):
    rng = random.Random(7)
    known = [("t", f"e{rng.randrange(60)}", n.upper() if i % 3 else n, "person") for i, n in enumerate(names(1) + names(2))]
    known += [("t", None, "customer#000000012", "person"), ("u", "e1", "customer#000000011", "person"), (None, "e2", "customer#000000011", "person")]
    schema = "tenant_id string, entity_id string, name string, type string"
    new = [("t", f"n{i}", n, "person") for i, n in enumerate(names(3))] + [("u", "n", "customer#000000010", "person"), ("t", "nameless", None, "person")]
    left, right = spark.createDataFrame(new, schema), spark.createDataFrame(known, schema)
    block = {r.entity_id: r.name_block for r in ent.with_block(left).collect()}
    owner = {}
    for r in ent.with_block(right).filter("tenant_id IS NOT NULL").collect():
        key = (r.tenant_id, r.name_block, r.name_key)
        owner[key] = min([x for x in (owner.get(key), r.entity_id) if x is not None], default=None)
    want = {}
    for t, e, n, _ in new:
        hits = []
        for (tenant, b, name), canonical in owner.items():
            if n is not None and (tenant, b) == (t, block[e]) and name != n.lower():
                r = SequenceMatcher(None, n.lower(), name).ratio()
                if r > 0.92:
                    hits.append((canonical is not None, canonical or "", r))
        if hits:
            _, canonical, r = min(hits)
            want[(t, e)] = (canonical or None, r)
    got = ent.fuzzy_matches(left, right).collect()
    assert len(got) == len(want) and {(r.tenant_id, r.entity_id): (r.canonical_id, r.ratio) for r in got} == want


def test_a_name_is_compared_until_its_first_match(spark, tmp_path):
    rows = [("t", "customer#000000100", f"customer#000000{i}", f"c{i}") for i in range(101, 200) for _ in range(2)]
    rows += [("t", "customer#000000100", "nobody", "c0"), ("t", "alone", "nobody", "c0"), ("t", "customer#000000100", "customer#100000100", "c101")]
    pairs = spark.createDataFrame(rows, "tenant_id string, left_name string, right_name string, canonical_id string").repartition(4)

    class Counted(SequenceMatcher):
        def ratio(self):
            with open(f"{tmp_path}/calls", "a") as f:
                f.write(".")
            return super().ratio()

    whole, similarity.SequenceMatcher = similarity.SequenceMatcher, Counted
    try:
        got = [tuple(r) for r in first_similar(pairs, ["tenant_id"], 0.92).collect()]
    finally:
        similarity.SequenceMatcher = whole
    assert got == [("t", "customer#000000100", "c101", min(SequenceMatcher(None, "customer#000000100", x).ratio()
                                                           for x in ("customer#000000101", "customer#100000100")))]
    assert len((tmp_path / "calls").read_text()) == 4      # both of c0, and the two names of c101
