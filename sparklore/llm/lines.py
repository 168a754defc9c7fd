"""Line dedup by the frequency of lines within a site (op 8).

A line is boilerplate if more than ``ratio`` of the pages of its host hold it. Hosts with fewer than
``least_pages`` pages have no boilerplate, and neither have pages without a host. Lines are counted by
128-bit hashes, once per page. The boilerplate lines of a host are few: their shares add up to at most the
mean number of lines of its pages, so there are at most that mean divided by ``ratio`` of them; they
travel to the pages as one array per host.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklore.llm.common import stored, with_arrow

RATIO, LEAST_PAGES = 0.1, 10
BLANKS = " \t\n\x0b\x0c\r"
#: Seed of the second hash: ``xxhash64(1, line)`` hashes the number first.
SECOND = xxhash.xxh64_intdigest(struct.pack("<i", 1), 42)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def html_lines(html: Column) -> Column:
    """The text of a web page, one line per block element; no scripts, styles, comments and tags."""
    plain = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    broken = F.regexp_replace(plain, r"(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|nav|article|section|header|footer|title|"
                                     r"table|tr|td|th|body|head|html|main|aside|pre|blockquote)\b[^>]*>", "\n")
    tidy = F.regexp_replace(F.regexp_replace(broken, r"<[^>]*>", ""), r"[ \t\r]*\n\s*", "\n")
    return F.regexp_replace(tidy, r"^\s+|\s+$", "")


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO,
                least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, lines: of each host that has some, the hashes of its boilerplate lines, as one array. Stored."""
    site = pages.filter(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = site.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = (site.select("host", F.explode(F.array_distinct(F.split("text", "\n", -1))).alias("line"))
             .filter(F.trim("line", F.lit(BLANKS)) != ""))
    found = (lines.groupBy("host", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
             .agg(F.count(F.lit(1)).alias("n")))
    often = (stored(found.filter("n > 1"))      # a line of one page is boilerplate of no host with enough pages
             .join(stored(totals.filter(F.col("pages") >= least_pages)).withColumnRenamed("host", "site"),
                   F.col("host") == F.col("site"))
             .filter(F.col("n") > F.col("pages") * ratio))
    return stored(often.groupBy("host").agg(F.collect_list(F.struct("h1", "h2")).alias("lines")))


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO,
                     least_pages: int = LEAST_PAGES, keep: list[str] | None = None) -> DataFrame:
    """``pages`` (or its columns ``keep`` and the text) without the boilerplate lines of their hosts.

    Adds n_lines and n_dropped (lines that are not blank). Lines are compared as they stand. A page's own repeats
    count once, and all of them are dropped. Null texts stay null with no lines; a page without a host, and one of which
    no line is dropped, keeps its text as it is. Repeated rows are pages like others. Columns of
    ``pages`` with the new names are replaced.
    """
    new = {text: "string", "n_lines": "long", "n_dropped": "long"}
    kept = [c for c in (pages.columns if keep is None else keep) if c not in new]
    lines = boilerplate(pages, host, text, ratio, least_pages)
    inner = pages.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(kept)],
                         F.col(host).alias("page_host"), F.col(text).alias("page_text"))
    # The hosts' arrays are small beside the pages; a host with many pages is split by the optimizer.
    both = inner.join(lines, F.col("page_host") == F.col("host"), "left")

    def run(batch: pa.RecordBatch) -> dict:
        texts, n_lines, n_dropped = [], [], []
        for t, found in zip(batch.column(0).to_pylist(), batch.column(1)):
            found = found.as_py() or []
            bad = {(x["h1"], x["h2"]) for x in found}
            parts = (t or "").split("\n")
            real = [bool(p.strip(BLANKS)) for p in parts]
            keeps = [p for p, r in zip(parts, real) if not (r and bad and _hashes(p) in bad)]
            n_lines.append(sum(real))
            n_dropped.append(len(parts) - len(keeps))
            texts.append(t if len(keeps) == len(parts) else "\n".join(keeps))
        return {"t": pa.array(texts, pa.string()), "n": pa.array(n_lines, pa.int64()),
                "d": pa.array(n_dropped, pa.int64())}

    out = with_arrow(both, run, new, ["page_text", "lines"], [f"d{i}" for i in range(len(kept))])
    return out.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(kept)], *new)


def _hashes(line: str) -> tuple[int, int]:
    """The two hashes of a line, equal to those of the SQL functions, as signed numbers."""
    data = line.encode()
    return tuple(np.array([xxhash.xxh64_intdigest(data, 42), xxhash.xxh64_intdigest(data, SECOND)], np.uint64)
                 .astype(np.int64).tolist())
