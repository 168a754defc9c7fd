"""Column expressions for text: redaction, sections, packing, spans, ids, summaries.

Everything here stays inside the JVM; sizes of intermediate arrays follow the size of one
document, never the size of a group of documents.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Redaction patterns and their placeholders, applied in this order.
REDACTIONS = [
    ("api_key", r"(sk-[A-Za-z0-9]{16,})", "[REDACTED_API_KEY]"),
    ("bearer", r"(?i)bearer\s+[A-Za-z0-9._\-]{16,}", "[REDACTED_TOKEN]"),
    ("key_value", r"(?i)(password|passwd|secret|token|api[_-]?key)\s*[:=]\s*\S+", "$1: [REDACTED]"),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----",
     "[REDACTED_PRIVATE_KEY]"),
    ("email", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    ("phone", r"\b(?:\+?86)?1[3-9]\d{9}\b", "[REDACTED_PHONE]"),
    ("national_id", r"\b\d{17}[\dXx]\b", "[REDACTED_ID]"),
    ("ssn", r"\b\d{3}-\d{2}-\d{4}\b", "[REDACTED_SSN]"),
]

# Sizes in estimated tokens, characters per token, sentence ends, line breaks.
CHUNK_TARGET, CHUNK_MAX, SPAN_TARGET = 1200, 2000, 200
CHARS_PER_TOKEN = 2.5
SENTENCE_END = r"(?U)(?<=[。.!?！？])\s*"
LINE_BREAK = r"\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
BLANK_LINES = r"(?U)\n\s*\n"
#: Characters behind the cursor that a search for the next part may walk over.
LOCATE_STEP = 65_536


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cat(first, *rest, literal_first: bool = True) -> Column:
    """Concatenate as strings; the first argument is a literal prefix by default."""
    head = F.lit(first) if literal_first and isinstance(first, str) else col(first)
    return F.concat(head, *[c.cast("string") for c in rest])


def strip(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    return strip(c) == ""


def redact(c) -> tuple[Column, Column]:
    """(clean text, number of hits); each pattern sees the text left by the ones before."""
    text, hits = col(c), F.lit(0)
    for _, pattern, placeholder in REDACTIONS:
        hits = hits + F.regexp_count(text, F.lit("(?U)" + pattern))
        text = F.regexp_replace(text, "(?U)" + pattern, placeholder)
    return text, hits


def redaction_hits(c) -> dict[str, Column]:
    """Hits of each pattern, counted where it runs in the sequence."""
    text, out = col(c), {}
    for name, pattern, placeholder in REDACTIONS:
        out[name] = F.regexp_count(text, F.lit("(?U)" + pattern))
        text = F.regexp_replace(text, "(?U)" + pattern, placeholder)
    return out


def content_hash(*parts) -> Column:
    """sha256 over the parts, each closed by a NUL."""
    pieces = []
    for p in parts:
        pieces += [col(p).cast("string"), F.lit("\0")]
    return F.sha2(F.concat(*pieces), 256)


def stable_id(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(content_hash(*parts), 1, 16))


def summary(c, limit) -> Column:
    """One line of at most ``limit`` characters, the ellipsis included."""
    s = F.replace(strip(c), F.lit("\n"), F.lit(" "))
    n = limit if isinstance(limit, Column) else F.lit(limit)
    kept = F.substring(s, F.lit(1), F.greatest(F.lit(1), n - 3))
    return F.when(F.length(s) > n, F.concat(kept, F.lit("..."))).otherwise(s)


def est_tokens(c) -> Column:
    return F.floor(F.length(col(c)) / CHARS_PER_TOKEN).cast("int")


def sentences(c) -> Column:
    """Pieces after each sentence end; blank pieces are kept, callers drop them."""
    return F.split(col(c), SENTENCE_END, -1)


def paragraphs(c) -> Column:
    return F.filter(F.split(col(c), BLANK_LINES, -1), lambda p: ~is_blank(p))


def let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once, also when ``body`` uses it inside
    further lambdas; a plain column there would be computed again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sections(c) -> Column:
    """array<struct<path, body, ord>>: heading path, text below it, and the number of
    earlier sections with the same path.

    Only headings go through the fold that keeps the title stack; bodies are slices of
    the line array, so the work is linear in the number of lines.
    """
    heading = r"(?U)^(#{1,6})\s+(.*)"
    start = F.struct(F.array().cast("array<string>").alias("stack"),
                     F.array().cast("array<struct<at:int,path:string>>").alias("out"))

    def push(acc, m):
        stack = F.concat(F.slice(acc["stack"], F.lit(1), m["level"] - 1), F.array(m["title"]))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(
            F.struct(m["at"].alias("at"), F.array_join(stack, " > ").alias("path")))).alias("out"))

    def heading_paths(lines):
        marks = F.filter(
            F.transform(lines, lambda x, i: F.struct(
                i.alias("at"), F.length(F.regexp_extract(x, heading, 1)).alias("level"),
                strip(F.regexp_extract(x, heading, 2)).alias("title"))),
            lambda m: m["level"] > 0)
        return F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("path"))),
                        F.aggregate(marks, start, push, lambda a: a["out"]))

    def bodies(lines, paths):
        def cut(h, i):
            begin = h["at"] + 2
            end = F.coalesce(F.get(paths, i + 1)["at"], F.size(lines))
            body = F.array_join(F.slice(lines, begin, F.greatest(end - begin + 1, F.lit(0))), "\n")
            return F.struct(h["path"].alias("path"), strip(body).alias("body"))
        return F.filter(F.transform(paths, cut), lambda s: s["body"] != "")

    def number(kept):
        # Equal paths are neighbours once sorted; a section's number is its distance to the first of them.
        def of_runs(by_path):
            firsts = F.filter(F.transform(by_path, lambda s, k: k), lambda k: (k == 0) | (
                F.get(by_path, k)["path"] != F.get(by_path, k - 1)["path"]))
            return let(firsts, lambda at: F.flatten(F.transform(at, lambda first, j: F.transform(
                F.sequence(first, F.coalesce(F.get(at, j + 1), F.size(by_path)) - 1),
                lambda k: F.struct(F.get(by_path, k)["i"].alias("i"), (k - first).alias("ord"))))))

        by_path = F.array_sort(F.transform(kept, lambda s, i: F.struct(s["path"].alias("path"), i.alias("i"))))
        return let(F.array_sort(let(by_path, of_runs)), lambda ords: F.transform(kept, lambda s, i: F.struct(
            s["path"].alias("path"), s["body"].alias("body"), F.get(ords, i)["ord"].alias("ord"))))

    return let(F.split(col(c), LINE_BREAK, -1), lambda lines: let(
        heading_paths(lines), lambda paths: let(bodies(lines, paths), number)))


def pack(pieces, target: int, hard_max: int | None, sep: str) -> Column:
    """Join neighbouring pieces greedily until the next one would pass ``target`` tokens.

    The fold carries the running size and the first index of each pack; a size of -1 means
    the pack was closed because it reached ``hard_max``.
    """
    zero = F.struct(F.lit(-1).alias("tok"), F.lit(0).alias("i"),
                    F.array().cast("array<int>").alias("starts"))

    def step(acc, t):
        fresh = (acc["tok"] < 0) | (acc["tok"] + t > target)
        tok = F.when(fresh, t).otherwise(acc["tok"] + t)
        if hard_max is not None:
            tok = F.when(tok >= hard_max, -1).otherwise(tok)
        starts = F.when(fresh, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"])
        return F.struct(tok.alias("tok"), (acc["i"] + 1).alias("i"), starts.alias("starts"))

    def joined(parts):
        starts = F.aggregate(F.transform(parts, est_tokens), zero, step, lambda a: a["starts"])
        return let(starts, lambda at: F.transform(at, lambda s, k: F.array_join(
            F.slice(parts, s + 1, F.coalesce(F.get(at, k + 1), F.size(parts)) - s), sep)))

    return let(pieces, joined)


def chunk_texts(body, target: int = CHUNK_TARGET, hard_max: int = CHUNK_MAX) -> Column:
    return pack(paragraphs(body), target, hard_max, "\n\n")


def _table_rows(block) -> Column:
    def under_header(rows):
        data = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))),
                        lambda r: ~strip(F.replace(r, F.lit("|"), F.lit(""))).rlike("^[-: ]*$"))
        return let(F.get(rows, F.lit(0)), lambda head: F.transform(data, lambda r: F.struct(
            F.concat_ws("\n", head, r).alias("content"), F.lit("table_row").alias("span_type"))))
    return let(F.filter(F.split(block, LINE_BREAK, -1), lambda r: ~is_blank(r)), under_header)


def span_texts(chunk, target: int = SPAN_TARGET) -> Column:
    """array<struct<content, span_type>>: table rows under their header, else packed sentences."""
    blocks = F.filter(F.transform(F.split(col(chunk), BLANK_LINES, -1), strip), lambda b: b != "")

    def of_block(b):
        table = b.contains("|") & b.contains("\n") & b.rlike(r"\|.*\|")
        packed = pack(F.filter(sentences(b), lambda s: ~is_blank(s)), target, None, "")
        text = F.transform(packed, lambda s: F.struct(s.alias("content"), F.lit("text").alias("span_type")))
        return F.when(table, _table_rows(b)).otherwise(text)

    return F.flatten(F.transform(blocks, of_block))


def locate_parts(parent, parts, fallback_to_cursor: bool) -> Column:
    """Zero-based offset of each part: searched forward, then anywhere, then a fallback; an empty part stands at the cursor.

    A search by position counts characters from the start of its text, so the fold carries the text from ``base`` on
    and cuts off what lies more than ``LOCATE_STEP`` characters behind the cursor.
    """
    zero = F.struct(F.lit(0).alias("cursor"), F.lit(0).alias("base"), col(parent).alias("rest"),
                    F.array().cast("array<int>").alias("offs"))

    def step(acc, p):
        done = acc["cursor"] - acc["base"]
        far = done > LOCATE_STEP
        left = F.struct(F.when(far, acc["cursor"]).otherwise(acc["base"]).alias("base"),
                        F.when(far, F.call_function("substring", acc["rest"], done + 1)).otherwise(acc["rest"]).alias("rest"))
        anywhere = let(F.call_function("locate", p, col(parent), F.lit(1)), lambda at: F.when(at > 0, at - 1).otherwise(
            acc["cursor"] if fallback_to_cursor else F.lit(0)))

        def found(now):
            ahead = F.call_function("locate", p, now["rest"], acc["cursor"] - now["base"] + 1)
            off = let(ahead, lambda at: F.when(at > 0, at - 1 + now["base"]).otherwise(anywhere))
            return let(F.when(p == "", acc["cursor"]).otherwise(off), lambda o: F.struct(
                F.greatest(acc["cursor"], o + F.length(p)).alias("cursor"), now["base"].alias("base"),
                now["rest"].alias("rest"), F.concat(acc["offs"], F.array(o)).alias("offs")))

        return let(left, found)

    return F.aggregate(parts, zero, step, lambda a: a["offs"])


def simple_tokens(c) -> Column:
    """Lower-case words without stemming."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"(?U)\p{Alnum}+"), F.lit(0))


def trigrams(c) -> Column:
    """Distinct trigrams of the lower-case words, each padded by two blanks before and one after.

    Words are put on lines of their own, and one pass of an overlapping match reads all
    trigrams; the dot does not cross a line end.
    """
    words = F.regexp_replace(F.lower(col(c)), r"(?U)^[^\p{Alnum}]+|[^\p{Alnum}]+$", "")
    padded = F.concat(F.lit("  "), F.regexp_replace(words, r"(?U)[^\p{Alnum}]+", " \n  "), F.lit(" "))
    return F.when(words == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.regexp_extract_all(padded, F.lit("(?=(.{3}))"), F.lit(1))))


def grams(c, n: int) -> Column:
    """Distinct character n-grams of a whole string."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit("(?s)(?=(.{%d}))" % n), F.lit(1)))


def page_markdown(c) -> Column:
    """Readable markdown of a web page: headings, list items and paragraphs."""
    x = col(c)
    for pattern, replacement in [
        (r"(?is)<!--.*?-->", ""), (r"(?is)<(script|style|head)\b.*?</(script|style|head)>", ""),
        (r"(?i)<h1[^>]*>", "\n\n# "), (r"(?i)<h2[^>]*>", "\n\n## "), (r"(?i)<h3[^>]*>", "\n\n### "),
        (r"(?i)<li[^>]*>", "\n- "), (r"(?i)</(h[1-6]|p|div|ul|ol|nav|article|section)>", "\n\n"),
        (r"(?i)<br\s*/?>", "\n"), (r"<[^>]+>", ""),
    ]:
        x = F.regexp_replace(x, pattern, replacement)
    for entity, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                         ("&nbsp;", " "), ("&amp;", "&")]:
        x = F.replace(x, F.lit(entity), F.lit(char))
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
