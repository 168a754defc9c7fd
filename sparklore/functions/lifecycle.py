"""Retention and confidence of facts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Decay constants in days, slow predicate words, penalties.
TAU_SLOW, TAU_FAST = 365.0, 30.0
SLOW_PREDICATES = ["is_a", "defined_as", "architecture", "depends_on", "part_of", "owns", "develops"]
CONTRADICTED_FACTOR, STALE_FACTOR = 0.5, 0.3


def tau_days(predicate: Column) -> Column:
    return F.when(F.lower(predicate).rlike("|".join(SLOW_PREDICATES)), TAU_SLOW).otherwise(TAU_FAST)


def retention(last_confirmed: Column, predicate: Column, now: float) -> Column:
    """exp(-days / tau); a fact that was never confirmed keeps 1."""
    days = F.greatest(F.lit(0.0), (F.lit(float(now)) - last_confirmed) / 86400.0)
    decayed = F.exp(-days / tau_days(F.coalesce(predicate, F.lit(""))))
    return F.when(F.coalesce(last_confirmed, F.lit(0.0)) <= 0, 1.0).otherwise(decayed)


def source_confidence(n: Column) -> Column:
    return 1.0 - 1.0 / (1.0 + n)


def confidence(source_count: Column, kept: Column, contradicted: Column, stale: Column) -> Column:
    score = (source_confidence(source_count) * kept
             * F.when(contradicted, CONTRADICTED_FACTOR).otherwise(1.0)
             * F.when(stale, STALE_FACTOR).otherwise(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
