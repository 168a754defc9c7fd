"""The quality classifier: held-out accuracy, calibration, parts against brute force."""

import random
import zlib

import numpy as np
import pytest

from sparklore.llm import classifier

SF = "/root/testdata/sf0.1"


def auc(pairs):
    """pairs: score, label."""
    good, bad = ([s for s, y in pairs if y == v] for v in (1, 0))
    return sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = classifier.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
               and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [(r["score"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 500 and auc(held) > 0.95
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.03           # calibrated
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.95
    # Labels that are held out change nothing.
    other = labels.filter("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 <> 0")
    again = {r["doc_id"]: r["score"] for r in classifier.classify(docs, other).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-6 for r in rows)


def test_rising_equals_brute_force():
    rng = random.Random(2)
    x = np.arange(40.0)
    n = np.array([rng.randint(1, 9) for _ in x], float)
    good = np.array([rng.randint(0, int(m)) for m in n], float)
    knots, levels = classifier.rising(x, n, good)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    # The isotonic fit at i is the greatest lower mean of stretches that end at or behind i.
    fit = [max(min(good[a:b + 1].sum() / n[a:b + 1].sum() for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert np.allclose(sorted(set(np.round(fit, 12))), np.round(levels, 12))


def test_cosines_approximate_the_kernel(monkeypatch):
    monkeypatch.setattr(classifier, "FEATURES", 20_000)
    m = len(classifier.STATISTICS)
    x = np.random.default_rng(1).standard_normal((6, m))
    z = classifier.Model(0.5, np.zeros(m), np.ones(m)).cosines(x)[:, :-1]
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-d / (2 * m))).max() < 0.03


def test_hard_cases(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):
        good = rng.random() < 0.5
        word = (lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))) if good else (lambda: rng.choice(["###", "$$", "BUY!!"]))
        rows.append((i, " ".join(word() for _ in range(rng.randint(5, 60))), int(good)))
    texts = [(i, t, 0.5, 9) for i, t, _ in rows] + [(500, None, 0.0, 0), (501, "", 0.0, 0), (502, " \n\t", 0.0, 0), (None, "some text", 0.0, 0),
                                                    (3, rows[3][1], 0.5, 9), (503, "word " * 300_000, 0.0, 0), (504, "ä" * 200_000, 0.0, 0), (505, "\x00\x85  ", 0.0, 0)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score double, predicted int")
    said = [(i, q, 1, "x") for i, _, q in rows] + [(3, 1 - rows[3][2], 1, "x"), (4, None, 1, "x"), (5, 7, 1, "x"), (None, 1, 1, "x"), (9999, 0, 1, "x")]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int, text string")
    out = classifier.classify(docs, labels)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    got = out.collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[500] == by[501] == by[502] and len([r for r in got if r["doc_id"] == 3]) == 2
    assert auc([(by[i], q) for i, _, q in rows if i != 3]) > 0.97
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert classifier.classify(docs.limit(0), labels).collect() == []
    # One class only, and no labels.
    assert {r["score"] for r in classifier.classify(docs, labels.filter("quality = 1 AND doc_id <> 3")).collect()} == {1.0}
    assert {(r["score"], r["predicted"]) for r in classifier.classify(docs, labels.limit(0)).collect()} == {(0.5, 1)}


@pytest.mark.parametrize("text", ["", "   "])
def test_no_words(text):
    assert classifier.statistics_of(text) == [0.0] * len(classifier.STATISTICS)
