"""SimHash near-duplicates by meet-in-the-middle ball hashing (op 6).

Two fingerprints link at 3 or fewer differing bits. Half of that radius, rounded down, is 1: every
fingerprint emits its variants within 1 bit, and variants are shuffled:

1. Whole variants. Fingerprints that share one differ in at most 2 bits, so all of them link, and a star
   around one says it all. At most 65 fingerprints share a variant. The components of these stars are
   formed first; a group of many near copies shrinks to a few components here, without any pairs.
2. Halves of variants. Of 3 differing bits at most 1 lies in the upper or in the lower half, so two
   linked fingerprints share a half of a variant that is an unchanged half of one of them. Colliding pairs from
   different components are deduplicated by component and verified.
3. Halves that more than ``CROWD`` fingerprints of different components share would give too many pairs. Their fingerprints
   meet in the middle in full: 3 is an odd distance, so one of a pair has odd parity; it emits its
   variants at 2 bits, the one with even parity emits those at 1 bit, and equal variants link.

A full exchange of all variants within 2 bits (2,081 per fingerprint) would give the same links with 30 times the rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparklore.llm.common import BROADCAST_ROWS, bounded, spread, stored, texts_of, with_arrow

WORDS, SEED, RADIUS = 3, 42, 3
#: Members of one half beyond which its pairs are not written out but met in the middle.
CROWD = 64
_STEP = 1 << 16


def fingerprint(text: str, words: int = WORDS) -> int:
    """The 64-bit SimHash of the word shingles of ``text``, A-Z in lower case; 0 without words. Signed."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(tokens))
    n, digest = len(tokens) - width + 1, xxhash.xxh64_digest
    count = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        upto = min(n, at + _STEP)
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(
            starts[at:upto].tolist(), ends[at + width - 1:upto + width - 1].tolist())])
        count += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n).view(">i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with fp (signed long). Null counts as the empty text."""
    def run(batch: pa.RecordBatch) -> dict:
        return {"fp": pa.array([fingerprint(t, words) for t in texts_of(batch.column(0))], pa.int64())}

    kept = [c for c in (docs.columns if keep is None else keep) if c != "fp"]
    return with_arrow(docs, run, {"fp": "long"}, [text], kept)


def _masks(bits) -> Column:
    """Numbers with the given bits set, as an array of longs."""
    values = [reduce(lambda a, b: a | (1 << b), x, 0) for x in bits]
    return F.array(*[F.lit(v - (1 << 64) if v >= 1 << 63 else v).cast("long") for v in values])


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (a, b: long); root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows the hooks to their ends by pointer doubling
    and contracts; at least half of the nodes go per round, whatever the shape of the graph.
    """
    spark = edges.sparkSession
    current = stored(edges.filter("a <> b").select("a", "b").distinct())
    found = None                                    # node, root
    while left := current.count():
        def side(df: DataFrame) -> DataFrame:       # an edge has two nodes
            return F.broadcast(df) if 2 * left <= BROADCAST_ROWS else df.hint("merge")

        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")))
        while True:
            far = hooks.select(F.col("a").alias("x"), F.col("p").alias("q"))
            jumped = stored(hooks.join(side(far), F.col("p") == F.col("x"))
                            .select("a", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            moved = not jumped.filter("moved").isEmpty()
            hooks = jumped.select("a", "p")
            if not moved:
                break
        if found is None:
            found = hooks.select(F.col("a").alias("node"), F.col("p").alias("root"))
        else:
            found = stored(found.join(side(hooks), F.col("root") == F.col("a"), "left")
                           .select("node", F.coalesce("p", "root").alias("root")))
        to = side(hooks.select(F.col("a").alias("x"), F.col("p").alias("q")))
        half = current.join(to, F.col("a") == F.col("x")).select(F.col("q").alias("a"), "b")
        current = stored(half.join(to, F.col("b") == F.col("x")).select("a", F.col("q").alias("b"))
                         .filter("a <> b").distinct())
    return found if found is not None else spark.range(0).selectExpr("id AS node", "id AS root")


def links(nodes: DataFrame) -> DataFrame:
    """fp, root: the component of each distinct fingerprint of ``nodes`` (fp: long, stored)."""
    one = _masks([(), *((i,) for i in range(64))])
    variants = spread(nodes, "fp").select("fp", F.explode(F.transform(one, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
    stars = (variants.groupBy("z").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
             .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b"))
    near = components(stars)
    placed = stored(nodes.join(bounded(near), F.col("fp") == F.col("node"), "left")
                    .select("fp", F.coalesce("root", "fp").alias("root")))
    # Spark takes a table to be as large as before it was exploded, so these joins say how they are made.
    # Halves: upper (side 1) and lower (side 0) 32 bits.
    halves = F.array(*[F.struct(F.lit(s).alias("side"),
                                (F.shiftrightunsigned("fp", 32) if s else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("v"))
                       for s in (0, 1)])
    exact = placed.select("fp", "root", F.explode(halves).alias("h")).select("fp", "root", "h.side", "h.v")
    low = _masks([(), *((i,) for i in range(32))])
    known = (exact.groupBy("side", "v").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    met = stored(spread(exact, "fp").select("fp", "root", "side", F.explode(F.transform(low, lambda m: F.col("v").bitwiseXOR(m))).alias("v"))
                 .join(known.hint("merge"), ["side", "v"]).filter("root <> least OR root <> most").select("side", "v", "fp", "root"))
    crowd = met.groupBy("side", "v").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > CROWD).select("side", "v")
    crowd = bounded(stored(crowd))
    few = met.join(crowd, ["side", "v"], "left_anti")
    other = exact.select("side", "v", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    pairs = (few.join(other.hint("merge"), ["side", "v"]).filter(F.col("root") != F.col("root2"))
             .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS))
    edges = pairs.select(F.col("root").alias("a"), F.col("root2").alias("b"))
    # Crowded halves: everything that meets there, unchanged halves included.
    crowded = met.join(crowd, ["side", "v"], "left_semi").select("fp", "root").union(
        exact.join(crowd, ["side", "v"], "left_semi").select("fp", "root")).distinct()
    odd = F.bit_count("fp") % 2 == 1
    two = _masks([(i, j) for i in range(64) for j in range(i)])
    single = _masks([(i,) for i in range(64)])

    def emitted(rows: DataFrame, masks: Column) -> DataFrame:
        return (rows.select("root", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("z")).distinct())

    crowded = spread(stored(crowded), "fp")
    middle = (emitted(crowded.filter(odd), two).withColumnRenamed("root", "a")
              .join(emitted(crowded.filter(~odd), single).withColumnRenamed("root", "b").hint("merge"), "z").filter("a <> b").select("a", "b"))
    merged = bounded(components(edges.union(middle)).withColumnRenamed("root", "whole"))
    return (placed.join(merged, F.col("root") == F.col("node"), "left")
            .select("fp", F.coalesce("whole", "root").alias("root")))


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """doc_id, text_hash, fp, root: of each row its fingerprint and the smallest one reachable by links.

    Null counts as the empty text; documents without words share fingerprint 0 and link like others. Rows
    that are repeated come back as often. Stored.
    """
    rows = stored(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                                           F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")),
                               words=words, keep=["doc_id", "text_hash"]))
    nodes = stored(rows.select("fp").distinct())
    found = stored(links(nodes).withColumnRenamed("fp", "fp2"))
    return stored(rows.join(bounded(found), F.col("fp") == F.col("fp2")).drop("fp2"))


def component_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id reachable by links."""
    rows = grouped(docs, text, doc_id, words)
    least = stored(rows.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id")))
    return (rows.join(bounded(least), F.col("root") == F.col("r"))
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest doc_id (null ids last).

    Of rows equal in id and text one stays.
    """
    return one_of_each(docs, grouped(docs, text, doc_id, words), text, doc_id)


def one_of_each(docs: DataFrame, rows: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, one of each root of ``rows`` (doc_id, text_hash, root), as ``keep_one`` chooses it."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("m")
    stay = stored(rows.groupBy("root").agg(best).select(F.col("m.doc_id").alias("stay_id"),
                                                        F.col("m.text_hash").alias("stay_hash")))
    columns = docs.columns
    inner = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(columns)], F.col(doc_id).alias("own_id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("own_hash"))
    left = inner.join(stay, F.col("own_id").eqNullSafe(F.col("stay_id")) & (F.col("own_hash") == F.col("stay_hash")),
                      "left_semi")
    first = F.row_number().over(Window.partitionBy("own_id", "own_hash").orderBy("own_hash"))
    return (left.withColumn("nth", first).filter("nth = 1")
            .select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(columns)]))
