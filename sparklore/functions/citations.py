"""Citations of the form [document:span] inside answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparklore.functions import text as tx

# Fixed value: the citation form.
CITATION = r"(?U)\[([\w\-]+):([\w\-]+)\]"


def citations(c) -> Column:
    """array<struct<document_id, span_id>> in order of first appearance, without repeats."""
    text = tx.col(c)
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1)).alias("document_id"),
                         F.regexp_extract_all(text, F.lit(CITATION), F.lit(2)).alias("span_id"))
    return F.array_distinct(pairs)


def claims(c) -> Column:
    """Sentences of an answer, stripped, blanks dropped. A citation after a full stop belongs
    to the next claim."""
    return F.filter(F.transform(tx.sentences(c), tx.strip), lambda s: s != "")
