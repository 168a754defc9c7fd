"""Quality classifier (op 11): random Fourier features, ridge by normal equations, isotonic calibration.

A text becomes a fixed list of statistics. Cosines of random projections of the standardised statistics approximate a
Gaussian kernel; their normal equations are summed within partitions and then over them, so the fit sees every labelled
document and only ``FEATURES`` squared numbers reach the driver. A part of the learning rows is kept from the ridge and calibrates
its scores: their counts in a fixed number of bins of the raw score are pooled to a rising curve.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklore.llm.common import matrix_sum, stored, texts_of, with_arrow

STATISTICS = ("log_bytes", "log_words", "word_length", "words_per_line", "upper", "digits", "stops", "cries", "symbols", "punctuation",
              "wide", "entropy", "different_words", "most_frequent", "repeated_lines", "compressed", "capital_words", "long_words")
#: Cosine features; ridge penalty per learning row; bins of the raw score; a standardised statistic counts up to so much.
FEATURES, RIDGE, BINS, CLIP, SEED = 256, 1e-4, 4096, 4.0, 11
#: Raw scores order documents within a step of the calibrated curve, by at most this much.
TIE = 1e-3
PARTS, CALIBRATION, HELD_OUT = 5, 1, 0

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "stops": b".,;:", "cries": b"!?",
            "symbols": b"#*$%&|<>", "punctuation": b"\"'()+-/=@[\\]^_`{}~", "blanks": b" \t\n\x0b\x0c\r"}
_CHUNK = 1 << 20


def statistics_of(text: str) -> list[float]:
    """The ``STATISTICS`` of a text; all zero without words. Shares are of the bytes that are not blank, or of words or lines."""
    data = text.encode()
    words = data.split()
    if not words:
        return [0.0] * len(STATISTICS)
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    count = {k: int(sum(seen[b] for b in v)) for k, v in _CLASSES.items()}
    inked = len(data) - count["blanks"]
    number: dict[bytes, int] = {}
    for w in words:
        number[w] = number.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    used = seen[seen > 0] / len(data)
    squeezed = sum(len(zlib.compress(data[i:i + _CHUNK], 1)) for i in range(0, len(data), _CHUNK))
    n = len(words)
    return [math.log1p(len(data)), math.log1p(n), inked / n, math.log1p(n / len(lines)),
            *(count[k] / inked for k in ("upper", "digits", "stops", "cries", "symbols", "punctuation")),
            int(seen[128:].sum()) / inked, float(-(used * np.log2(used)).sum()), len(number) / n, max(number.values()) / n,
            1 - len(set(lines)) / len(lines), squeezed / len(data), sum(w[:1].isupper() for w in words) / n,
            sum(len(w) > 14 for w in words) / n]


def statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with stats (array of double). Null counts as the empty text."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"stats": pa.array([statistics_of(t) for t in texts_of(batch.column(0))], pa.list_(pa.float64()))}

    return with_arrow(docs, run, {"stats": "array<double>"}, [text], [c for c in (docs.columns if keep is None else keep) if c != "stats"])


def part_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5: 0 is held out, 1 calibrates, the rest fits the ridge. Null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(PARTS)).cast("int")


@dataclass
class Model:
    """What scores a text: all parts have a fixed size."""
    base: float                     # score without a fit: the share of good labels, 0.5 without labels
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    coef: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel with a variance of one per statistic, and a constant."""
        m = stats.shape[1]
        rng = np.random.default_rng(SEED)
        directions, phase = rng.standard_normal((m, FEATURES)) / math.sqrt(m), rng.uniform(0, 2 * math.pi, FEATURES)
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        return np.hstack([math.sqrt(2 / FEATURES) * np.cos(x @ directions + phase), np.ones((len(x), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.coef

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.coef is None:
            return np.full(len(stats), self.base)
        raw = self.raw(stats)
        level = np.interp(raw, *self.knots)
        return np.clip((1 - TIE) * level + TIE * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    rows = pa.concat_arrays([column])       # a slice keeps the offsets of the whole
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def rising(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic curve of good / n over rising x: pooled adjacent violators, one knot at the mean of each pool."""
    pools: list[list[float]] = []           # n, good, sum of x
    for xi, ni, gi in zip(x.tolist(), n.tolist(), good.tolist()):
        pools.append([ni, gi, xi * ni])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            top = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], top)]
    return np.array([p[2] / p[0] for p in pools]), np.array([p[1] / p[0] for p in pools])


def fit(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", label: str = "quality") -> Model:
    """A model of ``label`` (0 or 1; others are ignored) from the rows of ``measured`` (doc_id, stats; stored) that are not held out.

    A document labelled twice is good if any label says so; rows that are repeated count as often. Labels of one class only, or none, give a constant score.
    """
    said = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("label_id")).agg(F.max(label).cast("double").alias("y"))
    rows = stored(measured.select(F.col(doc_id).alias("id"), "stats").withColumn("part", part_of(F.col("id")))
                  .filter(F.col("part") != HELD_OUT).join(said, F.col("id") == F.col("label_id")).select("stats", "y", "part"))
    m = len(STATISTICS)
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good"),
                    *[f(F.col("stats")[i]).alias(f"{f.__name__}{i}") for i in range(m) for f in (F.avg, F.stddev_pop)]).first()
    if not seen["n"] or seen["good"] in (0, seen["n"]):
        return Model(0.5 if not seen["n"] else seen["good"] / seen["n"])
    scale = np.array([seen[f"stddev_pop{i}"] for i in range(m)])
    model = Model(seen["good"] / seen["n"], np.array([seen[f"avg{i}"] for i in range(m)]), np.where(scale > 1e-9, scale, 1.0))

    def products(batch: pa.RecordBatch) -> np.ndarray:
        z = model.cosines(_matrix(batch.column(0)))
        return z.T @ np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False)[:, None]])

    ridge, rest = rows.filter(F.col("part") != CALIBRATION), rows.filter(F.col("part") == CALIBRATION)
    sums = matrix_sum(ridge.select("stats", "y"), products, (FEATURES + 1, FEATURES + 2))
    n = sums[-1, FEATURES]
    if not n:                               # few labels: every one of them calibrates
        return Model(model.base)
    penalty = np.diag([RIDGE * n + 1e-9] * FEATURES + [1e-9])
    model.coef = np.linalg.solve(sums[:, :-1] + penalty, sums[:, -1])

    def binned(batch: pa.RecordBatch) -> dict:
        raw = model.raw(_matrix(batch.column(0)))
        return {"bin": np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32), "raw": raw}

    counts = (with_arrow(rows if rest.isEmpty() else rest, binned, {"bin": "int", "raw": "double"}, ["stats"], ["y"])
              .groupBy("bin").agg(F.avg("raw").alias("raw"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).orderBy("bin").collect())
    model.knots = rising(*(np.array([float(r[c]) for r in counts]) for c in ("raw", "n", "good")))
    return model


def scores(measured: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``measured`` and score (0 to 1) for every row."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"score": model.score(_matrix(batch.column(0)))}

    return with_arrow(measured, run, {"score": "double"}, ["stats"], keep)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality",
             threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    held_out: crc32 of the id mod 5 is 0; such rows are never learned from. A null id has no labels and is not held out. Null
    and empty texts have statistics of zero and are scored like others; the whole of a long text counts. Other columns of
    ``docs`` play no part. No rows give no rows; without labels of both classes all scores are the share of good labels.
    """
    measured = stored(statistics(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), keep=["doc_id"]))
    named = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("quality"))
    return (scores(measured, fit(measured, named), ["doc_id"])
            .select("doc_id", F.coalesce(part_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted")))
