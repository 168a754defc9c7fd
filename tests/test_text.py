import re

from pyspark.sql import functions as F

from sparklore.functions import text as tx
from sparklore.functions.citations import citations, claims
from sparklore.functions.markdown import blocks
from sparklore.operators import compile as cp
from sparklore.operators.maintenance import eligible_name
from sparklore.operators.wiki import quality


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr.alias("y")).first()["y"]


DOC = "# 报告\n\n## 1. 预算\n预算为120万元。由财务确认。\n\n## 2. 明细\n| 项 | 值 |\n|---|---|\n| a | 1 |\n| b | 2 |\n"


def test_sections_chunks_and_table_rows(spark):
    docs = spark.createDataFrame([("t", "d", DOC)], "tenant_id string, document_id string, content string")
    chunks = cp.compile_chunks(docs)
    assert [r.section_path for r in chunks.orderBy("chunk_no").collect()] == ["报告 > 1. 预算", "报告 > 2. 明细"]
    rows = cp.compile_spans(chunks).filter("span_type = 'table_row'").orderBy("span_no").collect()
    assert [r.content for r in rows] == ["| 项 | 值 |\n| a | 1 |", "| 项 | 值 |\n| b | 2 |"]
    again = cp.compile_spans(cp.compile_chunks(docs))
    assert {r.span_id for r in again.collect()} == {r.span_id for r in cp.compile_spans(chunks).collect()}


def greedy(parts, target, hard_max, sep):
    """Brute-force packing."""
    out, open_, size = [], [], 0
    for p in parts:
        t = int(len(p) / 2.5)
        if open_ and size + t > target:
            out.append(sep.join(open_))
            open_, size = [], 0
        open_.append(p)
        size += t
        if hard_max and size >= hard_max:
            out.append(sep.join(open_))
            open_, size = [], 0
    return out + ([sep.join(open_)] if open_ else [])


def test_packing_equals_brute_force(spark):
    import random
    rnd = random.Random(7)
    for _ in range(8):
        parts = ["w" * rnd.randint(1, 60) for _ in range(rnd.randint(1, 30))]
        text = "\n\n".join(parts)
        assert one(spark, text, tx.chunk_texts("x", 30, 50)) == greedy(parts, 30, 50, "\n\n")


def test_spans_of_text_equal_brute_force(spark):
    text = "One two three. Four! Five six seven eight? 九十。十一 pi is 3.14 ok. last without end"
    pieces = [s for s in re.split(r"(?<=[。.!?！？])\s*", text) if s.strip()]
    got = [s["content"] for s in one(spark, text, tx.span_texts("x", 10))]
    assert got == greedy(pieces, 10, None, "")


def test_skipped_heading_levels(spark):
    text = "pre\n# A\n### B\nb\n### C\nc\n## D\nd\n# A\n### B\nagain"
    got = [(s["path"], s["body"], s["ord"]) for s in one(spark, text, tx.sections("x"))]
    # A skipped level keeps the shorter stack, so a repeated deep level nests.
    assert got == [("", "pre", 0), ("A > B", "b", 0), ("A > B > C", "c", 0), ("A > D", "d", 0), ("A > B", "again", 1)]


def test_numbers_of_equal_paths(spark):
    import random
    rnd = random.Random(3)
    heads = [rnd.choice(["# A", "# B", "# C", "## A", "## B"]) for _ in range(400)]
    text = "\n".join(f"{h}\nbody {i}" for i, h in enumerate(heads))
    stack, seen, want = [], {}, []
    for i, h in enumerate(heads):
        stack = stack[:h.index(" ") - 1] + [h.split()[1]]
        path = " > ".join(stack)
        want.append((path, f"body {i}", seen.get(path, 0)))
        seen[path] = seen.get(path, 0) + 1
    assert [(s["path"], s["body"], s["ord"]) for s in one(spark, text, tx.sections("x"))] == want
    assert one(spark, "", tx.sections("x")) == [] and one(spark, " \n ", tx.sections("x")) == []


def test_offsets_of_parts_equal_brute_force(spark):
    import random
    rnd = random.Random(5)
    words = [rnd.choice(["aa", "ab", "é", "报告", "x"]) * rnd.randint(1, 400) for _ in range(900)]
    text = " ".join(words)                  # several times longer than a search walks over
    assert len(text) > 3 * tx.LOCATE_STEP
    parts = words[:300] + ["not there", "", words[2] + " " + words[3]] + words[300:700] + ["", "nor there"] + words[700:]
    for fallback in (True, False):
        cursor, want = 0, []
        for p in parts:
            at = text.find(p, cursor)
            at = at if at >= 0 else text.find(p)
            at = at if at >= 0 else cursor if fallback else 0
            want.append(at)
            cursor = max(cursor, at + len(p))
        got = spark.createDataFrame([(text, parts)], "x string, parts array<string>").select(
            tx.locate_parts("x", F.col("parts"), fallback).alias("y")).first()["y"]
        assert got == want


def test_summary(spark):
    assert one(spark, "a" * 500, tx.summary("x", 200)) == "a" * 197 + "..."
    assert one(spark, "a\nb\nc", tx.summary("x", 10)) == "a b c"


def test_redaction(spark):
    clean, hits = tx.redact("x")
    raw = "key sk-abcdefghijklmnop1234 and email a@b.com phone 13912345678"
    out = one(spark, raw, clean)
    assert "[REDACTED_API_KEY]" in out and "[REDACTED_EMAIL]" in out and "[REDACTED_PHONE]" in out
    assert one(spark, raw, hits) >= 3
    assert one(spark, "token = abc", clean) == "token: [REDACTED]"


def test_name_eligibility(spark):
    names = {"AI": False, "X": False, "预算": True, "项目X": True, "AWS": True, "": False}
    for name, want in names.items():
        assert one(spark, name, eligible_name(F.col("x"))) == want


def test_citations_and_claims(spark):
    got = one(spark, "A [d1:sp1] B [d1:sp1] C [d2:sp2]", citations("x"))
    assert [(c["document_id"], c["span_id"]) for c in got] == [("d1", "sp1"), ("d2", "sp2")]
    assert one(spark, "One [a:b]. Two. ", claims("x")) == ["One [a:b].", "Two."]


def test_quality(spark):
    assert one(spark, "The budget is 120 and was confirmed [doc1:sp1].", quality("x")[2]) is True
    assert one(spark, "x", quality("x")[2]) is False


def test_markdown_blocks():
    text = "# T\npara one\nmore\n\n- a\n- b\n1. x\n> q1\n> q2\n```py\ncode\n```\n| h |\n|---|\n| v |\n#### deep"
    assert [b[0] for b in blocks(text)] == ["h", "p", "ul", "ol", "quote", "code", "table", "p"]


def test_trigrams(spark):
    assert sorted(one(spark, "Cat, cat", tx.trigrams("x"))) == sorted(["  c", " ca", "cat", "at "])
    assert one(spark, " ,", tx.trigrams("x")) == []


def test_page_of_offset(spark):
    points = spark.createDataFrame([("t", "d", o) for o in (0, 9, 10, 25)], "tenant_id string, document_id string, offset int")
    pages = spark.createDataFrame([("t", "d", 0, 1), ("t", "d", 10, 2), ("t", "d", 20, 3)],
                                  "tenant_id string, document_id string, start long, page long")
    got = {r.offset: r.page for r in cp.assign_pages(points, pages).collect()}
    assert got == {0: 1, 9: 1, 10: 2, 25: 3}
