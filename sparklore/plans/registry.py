"""Registry of runnable queries and the SQL that states their expected result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sparklore.plans.fixture_sql import TABLES
from sparklore.plans.fixtures import Kb


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Kb], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(kb) -> DataFrame`` under ``name`` with its oracle SQL body."""
    def add(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return add


def runnable(q: Query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: q.run(Kb(spark, sf_dir))


def _names_in(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(re.findall(r"\bkb_\w+", sql)) if n in TABLES]


def compose(body: str) -> str:
    """Put the fixture tables a query names in front of it as common table expressions."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in _names_in(TABLES[name]):
            if dep != name:
                visit(dep)
        ordered.append(name)

    for name in _names_in(body):
        visit(name)
    text = body.strip()
    head = re.match(r"(?i)with(\s+recursive)?\s+", text)
    rest = text[head.end():] if head else text
    named = " ".join([rest, *(TABLES[n] for n in ordered)])

    def cte(name: str) -> str:
        # Kept as a table only if it is read more than once.
        how = "MATERIALIZED " if len(re.findall(rf"\b{name}\b", named)) > 1 else ""
        return f"{name} AS {how}({TABLES[name].strip()})"

    ctes = ",\n".join(cte(n) for n in ordered)
    if not (ctes or head):
        return text
    return f"WITH {'RECURSIVE ' if head and head.group(1) else ''}{ctes}{', ' if ctes and head else chr(10)}{rest}"
