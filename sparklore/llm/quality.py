"""Quality rules with cutoffs whose risk is controlled (op 3).

Labelled documents are split by a hash into two holdouts. The first proposes, per stratum, a cutoff for each rule (the mildest
that rejects nearly as many bad documents as the strictest tolerable one) and an order of the rules by the bad documents they reject.
The second tests the rules together: first the best rule alone, then the best two joined by OR, and so on. The exact binomial
test must show that the union rejects at most a share ``alpha`` of the good documents; the first union that fails ends the
sequence (fixed-sequence testing), and the strata share the error ``delta`` (Bonferroni). So with probability
``1 - delta`` the rules of a stratum, all together, reject at most ``alpha`` of its good documents, in every stratum at once. A
stratum whose second holdout has fewer good labels than ``log(delta / strata) / log(1 - alpha)`` (437 with the defaults and four
strata) can show nothing; it gets no cutoffs and rejects nothing beyond the base rules.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklore.llm.common import small, stored, texts_of, with_arrow

#: Rules: what is measured; a document is worse the larger the value.
RULES: dict[str, Column | str] = {
    "symbols_per_word": "n_symbols / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "long_words": "word_chars / n_words",
    "short_words": "- word_chars / n_words",
    "few_words": "- n_words",
}
ALPHA, DELTA, CUTOFFS = 0.01, 0.05, 32
#: Share of the bad documents rejected by the strictest tolerable cutoff that a milder one must reject to be preferred.
NEARLY = 0.95
#: A proposed cutoff is tolerable if it rejects at most this share of ``alpha`` of the good documents of the first holdout.
TOLERABLE = 0.25
WINDOW = 5
MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
            "n_repeat_words": "long", "n_lines": "long"}
# Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
_CONTINUED = bytes(range(0x80, 0xC0))   # UTF-8 bytes that start no character


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in a window of words that occurs twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    grams = ids[:n - window + 1]
    for k in range(1, window):   # exact: pairs of (number of the first k words, next word), numbered anew
        pairs = grams * np.uint64(len(number)) + ids[k:n - window + 1 + k]
        if k < window - 1:
            grams = np.unique(pairs, return_inverse=True)[1].astype(np.uint64)
    order = np.argsort(pairs, kind="stable")
    ranked = pairs[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(pairs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def _measure(text: str) -> tuple[int, ...]:
    data = text.encode()
    words = data.split()         # bytes.split() cuts at ASCII blank and \t to \r only
    chars = len(data.translate(None, BLANKS + _CONTINUED))
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def measure(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the measures of ``text`` and base_failed.

    Null counts as the empty text: no words, base_failed true. Columns of ``docs`` with the names of
    measures are replaced. One row per row of ``docs``.
    """
    def run(batch: pa.RecordBatch) -> dict:
        rows = [_measure(t) for t in texts_of(batch.column(0))]
        return {name: pa.array([r[i] for r in rows], pa.int64()) for i, name in enumerate(MEASURES)}

    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*MEASURES, "base_failed")]
    return with_arrow(docs, run, MEASURES, [text], kept).withColumn("base_failed", F.expr(
        "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _value(rule: str) -> Column:
    """The measure of a rule; a document without words or lines breaks none."""
    return F.expr(f"CASE WHEN n_words > 0 AND n_lines > 0 THEN CAST({RULES[rule]} AS DOUBLE) END")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), exactly, as a regularised incomplete beta function."""
    if k >= n:
        return 1.0
    return _beta(n - k, k + 1, 1.0 - p)


def _beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    # The continued fraction of the incomplete beta function, from the front (modified Lentz).
    f, c, d = 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = 1.0 + term / c
        c = c if abs(c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1.0 - c * d) < 1e-13:
            break
    return front * (f - 1.0)


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", doc_id: str = "doc_id",
                alpha: float = ALPHA, delta: float = DELTA, cutoffs: int = CUTOFFS) -> DataFrame:
    """One row per stratum and rule in use: stratum, rule, cutoff, n_good, n_rejected (by this rule and those before it), tests.

    ``measured``: result of ``measure``, stored. ``labels``: doc_id, quality (1 good, 0 bad; others are
    ignored). A document labelled twice is good if any label says so. A null stratum is a stratum of its own.
    Good documents that fail the base rules take no part. Repeated rows count as documents.
    """
    said = (labels.filter("quality IN (0, 1)").groupBy(F.col(doc_id).alias("label_id"))
            .agg(F.max("quality").alias("quality")))
    half = (F.xxhash64(F.lit("holdout"), F.col(doc_id)).bitwiseAND(F.lit(1))).alias("half")
    values = F.array(*[F.struct(F.lit(r).alias("rule"), _value(r).alias("value")) for r in RULES]).alias("values")
    docs = stored(measured.filter("NOT base_failed").join(said, F.col(doc_id) == F.col("label_id"))
                  .select(F.col(stratum).alias("stratum"), "quality", half, values))
    rows = (docs.filter("half = 0").select("stratum", "quality", F.explode("values").alias("v"))
            .select("stratum", "quality", "v.rule", "v.value").filter("value IS NOT NULL"))
    # Proposals: quantiles of all documents of the first half, and of its bad ones.
    high = F.array(*[F.lit(round(0.5 + 0.5 * i / cutoffs, 6)) for i in range(1, cutoffs + 1)])
    even = F.array(*[F.lit(round(i / cutoffs, 6)) for i in range(cutoffs + 1)])
    grid = (rows.groupBy("stratum", "rule")
            .agg(F.percentile_approx("value", high, F.lit(10000)).alias("a"),
                 F.percentile_approx(F.when(F.col("quality") == 0, F.col("value")), even, F.lit(10000)).alias("b"))
            .select("stratum", "rule", F.array_sort(F.array_distinct(F.concat(
                "a", F.coalesce("b", F.array().cast("array<double>"))))).alias("grid")))
    # How many proposals each document exceeds: counts per number, at most as many as proposals.
    tried = (rows.alias("t").join(grid.alias("g"), F.expr("t.stratum <=> g.stratum AND t.rule = g.rule"))
             .select("t.stratum", "t.rule", "t.quality", "g.grid", F.expr("size(filter(g.grid, c -> t.value > c))").alias("over"))
             .groupBy("stratum", "rule", "quality", "over").agg(F.count(F.lit(1)).alias("n"), F.first("grid").alias("grid")))
    names = ["stratum", "rule", "cutoff", "bad"]

    def propose(pdf):
        grid, tolerable = pdf["grid"].iloc[0], []
        good, bad = (pdf[pdf["quality"] == q] for q in (1, 0))
        for i in range(len(grid) - 1, -1, -1):          # from the mildest cutoff on
            if good.loc[good["over"] > i, "n"].sum() > TOLERABLE * alpha * good["n"].sum():
                break
            tolerable.append((grid[i], int(bad.loc[bad["over"] > i, "n"].sum())))
        if not tolerable or not tolerable[-1][1]:
            return pd.DataFrame([], columns=names)
        cutoff, rejected = next(x for x in tolerable if x[1] >= NEARLY * tolerable[-1][1])
        return pd.DataFrame([[pdf["stratum"].iloc[0], pdf["rule"].iloc[0], cutoff, rejected]], columns=names)

    proposed = stored(tried.groupBy("stratum", "rule").applyInPandas(propose, "stratum string, rule string, cutoff double, bad long"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("bad")).alias("a"), "rule", "cutoff")))     # one entry per rule
    rules = proposed.groupBy(F.col("stratum").alias("of")).agg(order.alias("rules"))
    # The place of the first rule that a good document of the second half breaks; 0 if none.
    first = F.array_position(F.transform("rules", lambda r: F.exists(
        "values", lambda v: (v["rule"] == r["rule"]) & (v["value"] > r["cutoff"]))), True)
    broken = (docs.filter("half = 1 AND quality = 1").join(small(stored(rules)), F.col("stratum").eqNullSafe(F.col("of")))
              .groupBy("of", first.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.first("rules").alias("rules")))
    counted = broken.groupBy("of").agg(F.first("rules").alias("rules"), F.collect_list(F.struct("place", "n")).alias("places"))
    tests = rules.count()
    out = ["stratum", "rule", "cutoff", "n_good", "n_rejected", "tests"]

    def passed(batches):                                # a few numbers per stratum
        for pdf in batches:
            kept = []
            for of, in_order, places in zip(pdf["of"], pdf["rules"], pdf["places"]):
                n, rejected = sum(p["n"] for p in places), 0
                for i, rule in enumerate(in_order):
                    rejected += sum(p["n"] for p in places if p["place"] == i + 1)
                    if binomial_tail(rejected, n, alpha) > delta / tests:
                        break
                    kept.append([of, rule["rule"], rule["cutoff"], n, rejected, tests])
            yield pd.DataFrame(kept, columns=out)

    return counted.mapInPandas(passed, "stratum string, rule string, cutoff double, n_good long, n_rejected long, tests long")


def judge(measured: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``measured`` with broken_rules (array of names, sorted) and kept.

    ``cutoffs``: result of ``fit_cutoffs``, stored; pivoted to one row of a few numbers per stratum. A document whose stratum has no cutoffs breaks no rule.
    """
    wide = (cutoffs.groupBy(F.col("stratum").alias("__stratum"))
            .agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in RULES]))
    broken = F.array_compact(F.array(*[F.when(_value(r) > F.col(f"__{r}"), F.lit(r)) for r in sorted(RULES)]))
    out = [c for c in measured.columns if c not in ("broken_rules", "kept")]
    return (measured.join(small(wide), F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
            .select(*out, broken.alias("broken_rules"))
            .withColumn("kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)))


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of ``docs`` (doc_id, text and the stratum among its columns) that the rules keep, unchanged.

    Measures once for the cutoffs and once more while filtering, so whole texts are never shuffled.
    """
    cutoffs = stored(fit_cutoffs(stored(measure(docs, keep=["doc_id", stratum])), labels, stratum))
    columns = docs.columns
    inner = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(columns)],
                        F.col("text").alias("text"), F.col(stratum).alias(stratum))
    judged = judge(measure(inner), cutoffs, stratum).filter("kept")
    return judged.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(columns)])


def reasons(judged: DataFrame) -> DataFrame:
    """How many documents break each rule: rule, n."""
    return judged.select(F.explode("broken_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
