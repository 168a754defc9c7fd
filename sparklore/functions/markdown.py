"""Markdown blocks of a corpus."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

# How each kind of line starts.
LINE_KINDS = [
    ("fence", re.compile(r"\s*```(.*)")),
    ("h", re.compile(r"(#{1,3})\s+(.+)")),
    ("quote", re.compile(r"> (.*)")),
    ("ul", re.compile(r"\s*[-*]\s+(.*)")),
    ("ol", re.compile(r"\s*\d+\.\s+(.*)")),
]
TABLE_RULE = re.compile(r"\|[\s:|-]+\|")
PARAGRAPH_END = re.compile(r"#|>|\s*[-*]\s|\s*\d+\.\s|```|\|")


def _kind(line: str, following: str) -> tuple[str, re.Match | None]:
    if line.strip().startswith("|") and TABLE_RULE.fullmatch(following.strip()):
        return "table", None
    for name, pattern in LINE_KINDS:
        m = pattern.match(line)
        if m:
            return name, m
    return ("p" if line.strip() else "blank"), None


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.split("|")[1:-1]]


def blocks(text: str) -> Iterator[tuple[str, int, str]]:
    """(type, level, payload) of each block; lists, rows and tables have JSON payloads."""
    lines = (text or "").split("\n")
    at, end = 0, len(lines)

    def take(accept) -> list:
        nonlocal at
        got = []
        while at < end and (value := accept(lines[at])) is not None:
            got.append(value)
            at += 1
        return got

    while at < end:
        kind, m = _kind(lines[at], lines[at + 1] if at + 1 < end else "")
        if kind == "fence":
            at += 1
            body = take(lambda s: None if s.strip().startswith("```") else s)
            at += 1
            yield "code", 0, json.dumps({"lang": m[1].strip(), "content": "\n".join(body)}, ensure_ascii=False)
        elif kind == "table":
            head = _cells(lines[at])
            at += 2
            rows = take(lambda s: _cells(s) if s.strip().startswith("|") else None)
            yield "table", 0, json.dumps({"headers": head, "rows": rows}, ensure_ascii=False)
        elif kind == "h":
            at += 1
            yield "h", len(m[1]), m[2]
        elif kind == "quote":
            yield "quote", 0, " ".join(take(lambda s: s[2:] if s.startswith("> ") else None))
        elif kind in ("ul", "ol"):
            pattern = dict(LINE_KINDS)[kind]
            items = take(lambda s: hit[1] if (hit := pattern.match(s)) else None)
            yield kind, 0, json.dumps(items, ensure_ascii=False)
        elif kind == "p":
            first = lines[at]
            at += 1
            rest = take(lambda s: s if s.strip() and not PARAGRAPH_END.match(s) else None)
            yield "p", 0, " ".join([first, *rest])
        else:
            at += 1


@udtf(returnType="block_no int, type string, level int, payload string")
class MarkdownBlocks:
    """The blocks of one text, row by row: a task holds one document at a time. Usable in SQL after ``register``."""

    def eval(self, text: str):
        for n, block in enumerate(blocks(text)):
            yield n, *block


def register(spark: SparkSession, name: str = "markdown_blocks") -> None:
    """Makes the function known to SQL: ``SELECT d.id, b.* FROM docs d, LATERAL markdown_blocks(d.content) b``."""
    spark.udtf.register(name, MarkdownBlocks)


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, block_no, type, level, payload) of every document. A null text has no blocks."""
    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("_text"))
    return rows.lateralJoin(MarkdownBlocks(F.col("_text").outer())).drop("_text")
