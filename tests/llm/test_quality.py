"""Quality rules against brute force, and the guarantee of the cutoffs."""

import math
import random
import re
from collections import Counter

import pytest

from sparklore.llm import quality

SCHEMA = "doc_id long, text string, lang string, n_words string, kept string, d0 string, stratum string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "w") for i, t, s in rows], SCHEMA)


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    twice = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(twice), len(lines))


def test_measures():
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice("ab \n\té#　\x85\x0b|") for _ in range(rng.randint(0, 90)))
        assert quality._measure(t) == brute(t), repr(t)
    long = " ".join(rng.choice(["x", "y", "zz"]) for _ in range(3000))
    assert quality._measure(long) == brute(long)


@pytest.mark.parametrize("n, p", [(10, 0.3), (500, 0.01), (4000, 0.02)])
def test_binomial_tail(n, p):
    total = 0.0
    for k in range(0, 40):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) if k <= n else 0
        assert quality.binomial_tail(k, n, p) == pytest.approx(min(1.0, total), rel=1e-9, abs=1e-12)


@pytest.fixture(scope="module")
def corpus():
    rng, rows, labels = random.Random(2), [], []
    for i in range(6000):
        lang, bad = rng.choice(["en", "fr", None]), rng.random() < 0.15
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(30, 60))]
        if bad:
            words = [w + "#|" * rng.randint(1, 3) if rng.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_cutoffs(spark, corpus):
    rows, labels = corpus
    said = spark.createDataFrame([*labels, (1, 0), (2, None), (3, 7)], "doc_id long, quality int")
    measured = quality.stored(quality.measure(docs(spark, rows)))
    cutoffs = quality.stored(quality.fit_cutoffs(measured, said))
    found = cutoffs.collect()
    assert {(r["stratum"], r["rule"]) for r in found} >= {(s, "symbols_per_word") for s in ("en", "fr", None)}
    for r in found:
        assert quality.binomial_tail(r["n_rejected"], r["n_good"], quality.ALPHA) <= quality.DELTA / r["tests"]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(measured, cutoffs).collect()}
    good, bad = [kept[i] for i, q in labels if q], [kept[i] for i, q in labels if not q]
    for lang in ("en", "fr", None):        # all rules of a stratum together
        of = [kept[i] for (i, _, s), (_, q) in zip(rows, labels) if s == lang and q]
        assert sum(of) >= (1 - quality.ALPHA) * len(of)
    assert len(good) > 4000
    assert sum(bad) <= 0.1 * len(bad)
    out = quality.filter_documents(docs(spark, rows), said)
    assert out.columns == docs(spark, rows[:1]).columns
    assert {r["doc_id"] for r in out.collect()} == {i for i in kept if kept[i]}


def test_joint_bound_on_documents(spark):
    """At sf0.1 the base survivors among labelled good documents are rejected by no more than alpha per stratum."""
    docs_, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    measured = quality.stored(quality.measure(docs_, keep=["doc_id", "lang"]))
    judged = quality.judge(measured, quality.stored(quality.fit_cutoffs(measured, labels))).join(labels.filter("quality = 1"), "doc_id")
    for r in judged.filter("NOT base_failed").groupBy("lang").agg({"doc_id": "count", "kept": "count"}).collect():
        n = r["count(doc_id)"]
        lost = judged.filter("NOT base_failed AND NOT kept").filter(judged["lang"].eqNullSafe(r["lang"])).count()
        assert lost <= quality.ALPHA * n


def test_few_labels_reject_nothing_beyond_the_base(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, "en"), (1, text, "en"), (2, None, "en"), (3, "", None), (4, "# " * 40, "en"), (None, text, None)]
    for labels in ([(1, 1), (4, 0)], []):
        out = quality.judge(quality.measure(docs(spark, rows)), quality.fit_cutoffs(
            quality.measure(docs(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int")))
        got = sorted(((r["doc_id"], r["n_words"], r["base_failed"], r["kept"]) for r in out.collect()), key=str)
        assert got == sorted([(1, 20, False, True), (1, 20, False, True), (2, 0, True, False), (3, 0, True, False),
                              (4, 40, True, False), (None, 20, False, True)], key=str)
    nothing = quality.filter_documents(docs(spark, []), spark.createDataFrame([], "doc_id long, quality int"))
    assert nothing.collect() == []
