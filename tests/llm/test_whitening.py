"""Whitening against numpy's eigenvectors of the covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest

from sparklore.llm import whitening

SF = "/root/testdata/sf0.01"


def brute(rows, components=16):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    p = max({len(v) for _, v in kept}, key=lambda q: (sum(len(v) == q for _, v in kept), q))
    kept = [(i, v) for i, v in kept if len(v) == p]
    fit = sorted({tuple(v) for _, v in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[float(Fraction(n * c - t, n)) for c, t in zip(v, s)] for v in fit])
    e, axes = np.linalg.eigh(a.T @ a / n)
    e, axes = e[::-1], axes[:, ::-1]
    m = min(components, int((e > e[0] * 1e-13).sum()))
    out = {}
    for i, v in kept:
        c = np.array([float(Fraction(n * x - t, n)) for x, t in zip(v, s)])
        out[i] = (n, sum((n * x - t) ** 2 for x, t in zip(v, s)), c @ axes[:, :m] / np.sqrt(e[:m]))
    return out, e[:m] / e.sum()


def compare(got, rows, components=16, close=1e-7):
    want, explained = brute(rows, components)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert by.keys() == want.keys()
    m = len(explained)
    sign = None
    for i, parts in by.items():
        n, deviation, w = want[i]
        assert sorted(parts) == [*range(1, m + 1)]
        assert {(r["n"], r["deviation"]) for r in parts.values()} == {(n, deviation)}
        mine = np.array([parts[c]["whitened"] for c in range(1, m + 1)])
        if sign is None or (np.abs(w) > 1).any():
            sign = np.where(np.abs(w) > 0.3, np.sign(mine * w), 0) if sign is None else np.where(np.abs(w) > 0.3, np.sign(mine * w), sign)
        assert np.allclose(np.abs(mine), np.abs(w), atol=close, rtol=close)
        assert np.allclose([parts[c]["explained"] for c in range(1, m + 1)], explained, rtol=1e-9)
        assert all(parts[c]["identity_error"] < 1e-9 for c in parts)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = whitening.whitened(table).collect()
    assert len(got) == 16 * table.count()
    compare(got, [(r["vec_id"], r["embedding"]) for r in table.collect()], close=1e-6)
    w = np.zeros((len(got) // 16, 16))
    index = {}
    for r in got:
        w[index.setdefault(r["vec_id"], len(index)), r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(w.T, bias=True) - np.eye(16)).max() < 1e-9      # one sign for all rows


def test_hard_cases(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((80, 5)) * [10, 3, 1, 0.5, 0.2]
    rows = [(i, [*v, 2.0, 2 * v[0]]) for i, v in enumerate(base.tolist())]     # a constant and a dimension that follows another
    nan = float("nan")
    rows += [(100, None), (101, []), (102, [nan] * 7), (103, [1.0] * 6), (104, [None] * 7), (105, [float("-inf")] * 7),
             (None, rows[0][1]), (5, rows[5][1]), (200, rows[3][1])]
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, component int, x string")
    got = whitening.whitened(table).collect()
    compare(got, rows)
    assert len([r for r in got if r["vec_id"] == 5]) == 2 * len([r for r in got if r["vec_id"] == 6])     # repeated rows come back
    few = whitening.whitened(table, components=2).collect()
    compare(few, rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert out.collect() == [] and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits(spark):
    rows = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [0.0, 5.0])]
    got = {r["vec_id"]: r for r in whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()}
    assert got[1]["deviation"] is None and got[2]["deviation"] is None and got[3]["deviation"] is not None
    assert whitening.deviations(np.array([[1 << 61]]), 8, [1 << 61])[0, 0] == 7 << 61
