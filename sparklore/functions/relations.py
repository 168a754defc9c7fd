"""Relation vocabulary: normalisation and attributes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relation types with inverse, acyclic and symmetric marks.
RELATION_SPECS = [
    ("uses", "used_by", False, False),
    ("depends_on", "required_by", True, False),
    ("contradicts", None, False, True),
    ("caused_by", "causes", True, False),
    ("fixed_by", "fixes", False, False),
    ("superseded_by", "supersedes", True, False),
    ("references", None, False, False),
    ("related_to", None, False, True),
    ("works_for", None, False, False),
    ("owns", None, False, False),
    ("develops", None, False, False),
    ("belongs_to", None, False, False),
    ("part_of", None, False, False),
    ("causes", "caused_by", True, False),
    ("co_mention", None, False, True),
]
RELATION_TYPES = [name for name, *_ in RELATION_SPECS]
ACYCLIC_TYPES = [name for name, _, acyclic, _ in RELATION_SPECS if acyclic]

# Spellings accepted for a relation type.
RELATION_ALIASES = {
    "use": "uses", "using": "uses", "used_by": "uses",
    "depends": "depends_on", "depends on": "depends_on", "dependency": "depends_on",
    "blocks": "depends_on", "blocked_by": "depends_on",
    "contradict": "contradicts", "conflicts_with": "contradicts", "conflict": "contradicts",
    "caused by": "caused_by", "causes": "causes", "cause": "causes",
    "fixes": "fixed_by", "fixed by": "fixed_by", "resolved_by": "fixed_by",
    "replaced_by": "superseded_by", "supersedes": "superseded_by", "superseded by": "superseded_by",
    "reference": "references", "relates_to": "related_to", "related": "related_to",
}
# Spellings that name the opposite direction of the type they map to.
INVERSE_ALIASES = ["used_by", "blocks", "fixes", "supersedes"]


def _cleaned(value: Column) -> Column:
    lowered = F.replace(F.lower(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)^\s+|\s+$", "")),
                        F.lit("-"), F.lit("_"))
    return F.regexp_replace(lowered, r"(?U)\s+", " ")


def normalize_relation(value: Column, mode: str = "strict") -> Column:
    """A known relation type; ``tolerant`` keeps unknown non-empty names."""
    cleaned = _cleaned(value)
    if mode == "tolerant":
        name = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)[\s-]+", "_")
        return F.when(name == "", "related_to").otherwise(name)
    aliases = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in RELATION_ALIASES.items()))
    known = F.coalesce(F.element_at(aliases, cleaned), F.replace(cleaned, F.lit(" "), F.lit("_")))
    safe = F.regexp_replace(known, "[^a-z0-9_]", "")
    return F.when(safe.isin(RELATION_TYPES), safe).otherwise("related_to")


def names_inverse(value: Column) -> Column:
    return _cleaned(value).isin(INVERSE_ALIASES)


def spec_table(spark: SparkSession) -> DataFrame:
    """The fixed 15-row attribute table."""
    return spark.createDataFrame(RELATION_SPECS,
                                 "relation_type string, inverse string, acyclic boolean, symmetric boolean")


def relation_id(tenant: str, source: str, kind: str, target: str) -> Column:
    return F.concat(F.lit("rl_"), F.substring(F.sha2(F.concat_ws(":", tenant, source, kind, target), 256), 1, 16))
