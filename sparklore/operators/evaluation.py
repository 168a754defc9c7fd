"""Citations, claim verification and retrieval quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklore.functions.citations import citations, claims

# Entailment score and share of verified claims that suffice.
ENTAILED_MIN, SUFFICIENT_RATIO = 0.5, 0.6


def extract_citations(answers: DataFrame, column: str = "answer") -> DataFrame:
    keep = [c for c in answers.columns if c != column]
    return answers.select(*keep, F.posexplode(citations(column)).alias("pos", "c")).select(*keep, "pos", "c.*")


def split_claims(answers: DataFrame, column: str = "answer") -> DataFrame:
    """One row per claim with its citations."""
    keep = [c for c in answers.columns if c != column]
    return answers.select(*keep, F.posexplode(claims(column)).alias("claim_no", "claim")).withColumn(
        "cites", citations("claim"))


def cited_spans(claim_rows: DataFrame) -> DataFrame:
    return claim_rows.select("tenant_id", "answer_id", "claim_no", F.explode("cites").alias("c")).select(
        "tenant_id", "answer_id", "claim_no", "c.*")


def resolve_citations(cites: DataFrame, spans: DataFrame) -> DataFrame:
    """Every citation with whether its span exists in that document and tenant."""
    known = spans.select("tenant_id", "document_id", "span_id", F.lit(True).alias("hit")).distinct()
    return cites.join(known, ["tenant_id", "document_id", "span_id"], "left").withColumn(
        "resolved", F.coalesce("hit", F.lit(False))).drop("hit")


def verify_claims(claim_rows: DataFrame, spans: DataFrame, scores: DataFrame) -> DataFrame:
    """True if a resolvable citation is entailed with enough score, NULL without citations."""
    found = resolve_citations(cited_spans(claim_rows), spans).filter("resolved")
    good = found.join(scores, ["tenant_id", "answer_id", "claim_no", "span_id"], "left").groupBy(
        "tenant_id", "answer_id", "claim_no").agg(
        F.bool_or(F.coalesce(F.col("entailed") & (F.col("score") >= ENTAILED_MIN), F.lit(False))).alias("ok"))
    return claim_rows.join(good, ["tenant_id", "answer_id", "claim_no"], "left").withColumn(
        "verified", F.when(F.size("cites") > 0, F.coalesce("ok", F.lit(False)))).drop("ok")


def verify_answers(verified: DataFrame) -> DataFrame:
    """Share of verified claims among cited ones, and whether it suffices."""
    n = verified.groupBy("tenant_id", "answer_id").agg(
        F.count(F.lit(1)).alias("claims"), F.count("verified").alias("cited"), F.count_if("verified").alias("verified"))
    ratio = F.coalesce(F.try_divide(F.col("verified"), F.col("cited")), F.lit(0.0))
    return n.withColumn("verified_ratio", ratio).withColumn(
        "sufficient", (F.col("cited") > 0) & (F.col("verified_ratio") >= SUFFICIENT_RATIO))


def escalations(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Answers of the simple route that are not sufficient."""
    weak = verdicts.filter(~F.col("sufficient")).select("tenant_id", "answer_id")
    return answers.filter("route = 'simple'").join(weak, ["tenant_id", "answer_id"], "left_semi")


def retrieval_quality(questions: DataFrame, results: DataFrame, gold: DataFrame, k: int = 8) -> DataFrame:
    """recall@k (any gold span found) and mean reciprocal rank of the first one, per bucket."""
    first = results.filter(F.col("rank") <= k).join(gold, ["qid", "span_id"], "left_semi").groupBy("qid").agg(
        F.min("rank").alias("hit_rank"))
    rows = questions.select("qid", "bucket").join(first, "qid", "left")
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("hit_rank").isNotNull().cast("double")).alias("recall_at_k"),
        F.avg(F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0))).alias("mrr"))


def faithfulness(questions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Mean verified ratio of the answers per bucket; an unanswered question counts 0."""
    rows = questions.select("tenant_id", "answer_id", "bucket").join(
        verdicts.select("tenant_id", "answer_id", "verified_ratio"), ["tenant_id", "answer_id"], "left")
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"),
                                      F.avg(F.coalesce("verified_ratio", F.lit(0.0))).alias("faithfulness"))


def metric_diff(before: DataFrame, after: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Old value, new value and change of every metric per key, in long form."""
    def long(df, name):
        return df.select(key, F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("m")).select(key, "m.*")
    return long(before, "before").join(long(after, "after"), [key, "metric"], "full").withColumn(
        "change", F.col("after") - F.col("before"))
