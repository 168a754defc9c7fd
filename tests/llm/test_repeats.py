"""Removal of repeated byte strings against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from sparklore.llm import repeats, sais

SCHEMA = "doc_id long, text string, spans string, kept string, anchor string"


def brute(texts, width):
    seen = Counter(t[i:i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i:i + width]] > 1:
                gone[i:i + width] = [True] * width
        starts = [i for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1])]
        out.append((len(t), sum(gone), len(starts), bytes(c for c, g in zip(t, gone) if not g)))
    return out


def suffixes(data):
    return sorted(range(len(data)), key=lambda i: data[i:])


@pytest.mark.parametrize("seed", range(60))
def test_suffix_array_and_prefixes(seed):
    rng = random.Random(seed)
    data = bytes(rng.randrange(rng.choice([1, 2, 3, 26, 256])) for _ in range(rng.choice([1, 2, 10, 80, 400])))
    if seed % 3 == 0:
        data = data[:1 + len(data) // 4] * 5
    if seed % 10 == 0:
        data = bytes(range(256)) * 8 + data + b"a" * 300 + b"b" + b"a" * 300
    t = np.frombuffer(data, np.uint8)
    order = sais.suffix_array(t)
    assert order.tolist() == suffixes(data)
    length, before = sais.permuted_common_prefixes(t, order)
    rank = {i: r for r, i in enumerate(order.tolist())}
    for i in range(len(data)):
        j = order[rank[i] - 1] if rank[i] else -1
        assert before[i] == j
        n = 0
        while j >= 0 and max(i, j) + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        assert length[i] == n


def corpus(seed, width):
    rng = random.Random(seed)

    def text(n):
        return "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [text(rng.randrange(width, 4 * width)) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [text(rng.randrange(0, width))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p))
            parts += [p[a:], text(rng.randrange(0, 5))]
        texts.append("".join(parts))
    return texts + [texts[3], texts[3], texts[5][1:], "", None, "x" * (3 * width), "ab" * (2 * width), "z" * width, text(width - 1)]


def got(spark, rows, width, gram):
    docs = spark.createDataFrame([(i, t, "s", "k", "a") for i, t in rows], SCHEMA)
    out = repeats.remove_repeats(docs, width=width, gram=gram)
    assert set(docs.columns) <= set(out.columns)
    return sorted(((r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"]))
                   for r in out.collect()), key=repr)


@pytest.mark.parametrize("crowd, seed", [(500, 1), (2, 2), (1, 3)])
def test_equals_brute_force(spark, monkeypatch, crowd, seed):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    monkeypatch.setattr(repeats, "BLOCKS", (16, 4, 1))
    width = 40
    texts = corpus(seed, width)
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[6]), (None, None)]
    want = [(i, *b) for (i, _), b in zip(rows, brute([(t or "").encode() for _, t in rows], width))]
    assert got(spark, rows, width, 8) == sorted(want, key=repr)


def test_long_text_is_cut_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "STEP", 100)
    rng = random.Random(3)
    text = bytes(rng.randrange(3) for _ in range(1000))
    who, _, _, _, at, windows, _ = repeats._contexts_of([b"q" * 20, text, text[:50]], 40, 8)
    for i, t in ((1, text), (2, text[:50])):
        starts = [s for w, a, n in zip(who, at, windows) if w == i for s in range(a, a + n)]
        assert sorted(starts) == list(range(len(t) - 39))


def test_no_rows(spark):
    assert got(spark, [], 40, 8) == []
    assert got(spark, [(1, None)], 40, 8) == [(1, 0, 0, 0, b"")]
