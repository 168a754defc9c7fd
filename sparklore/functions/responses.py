"""Reading JSON answers of a model from a text column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklore.functions.text import strip

EXTRACT_SCHEMA = ("facts array<struct<subject:string,predicate:string,object:string,"
                  "qualifiers:map<string,string>,source_span_index:array<int>>>,"
                  "entities array<struct<name:string,type:string,span_index:array<int>>>")
RELATION_SCHEMA = ("relations array<struct<source:string,relation_type:string,target:string,"
                   "source_span_index:array<int>>>")
DIGEST_SCHEMA = ("title string, digest string, facts array<struct<subject:string,predicate:string,"
                 "object:string,source_span_ids:array<string>>>")


def unfence(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"^```json\s*|\s*```$", "")


def _valid(c: Column) -> Column:
    """The text if it is one JSON object, else NULL; ``try_parse_json`` alone lets a tail pass."""
    return F.when(c.startswith("{") & c.endswith("}") & F.try_parse_json(c).isNotNull(), c)


def json_text(c: Column) -> Column:
    """The JSON object of an answer: strict, else the outermost braces, else those without
    trailing commas and line breaks; NULL if nothing parses."""
    bare = unfence(c)
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    cleaned = F.translate(F.regexp_replace(inner, r"(?U),\s*([}\]])", "$1"), "\n\r", "  ")
    return F.coalesce(_valid(bare), _valid(inner), _valid(cleaned))


def parse(c: Column, schema: str) -> Column:
    return F.from_json(json_text(c), schema)


def pick_spans(index: Column, span_ids: Column) -> Column:
    """Span ids at the listed positions; positions outside the list are dropped."""
    inside = F.filter(F.coalesce(index, F.array().cast("array<int>")),
                      lambda i: (i >= 0) & (i < F.size(span_ids)))
    return F.transform(inside, lambda i: F.get(span_ids, i))
