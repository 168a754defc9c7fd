"""Mixing sources to target weights by capped water-filling (op 2). DataFrame operations only.

Targets: each source gets its share by weight of all words; what a source would get beyond ``epochs`` times
its own size is shared again by weight among the others, until no source is above its cap. Then
each document is taken ``floor(target / size of its source)`` times, and some documents once more, in the order of a seeded
hash: all up to the first that would pass the rest of the target, then, without the documents that are too large for what is left,
further on in the same order, and so on. Borders are found on two levels of hash cells, so no task sees the rows of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparklore.llm.common import WORD, small, stored

EPOCHS, SEED = 3, 17
#: Fixed value: the weights of sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Bits of the hash per level; cells per source on each level. Steps of the walk.
BITS, STEPS = 12, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(sources: DataFrame, source: str = "source") -> DataFrame:
    """``sources`` with ``ordinal`` (from 0) by code point, null last; no task sees them all.

    Sorts by ranges, counts each range, and adds what stands before. The sorted rows are stored
    first, so a repeated task cannot cut the ranges differently.
    """
    order = [F.col(source).isNull(), F.col(source)]
    ranged = stored(sources.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("__place", F.monotonically_increasing_id()))
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    # One row per range, as many as partitions: a running sum over them.
    before = counts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return (ranged.withColumn("__part", part).join(F.broadcast(before), "__part")
            .withColumn("ordinal", F.col("__before") + place).drop("__part", "__place", "__before"))


def with_weights(sources: DataFrame, weights=WEIGHTS, source: str = "source") -> DataFrame:
    """``sources`` with ``weight``: ``weights`` in turn, sources by code point, null last."""
    return (numbered(sources, source)
            .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                               (F.col("ordinal") % len(weights) + 1).cast("int"))).drop("ordinal"))


def targets(sources: DataFrame, epochs: float = EPOCHS, total: float | None = None) -> DataFrame:
    """``sources`` (source_size, weight > 0) with ``target``: capped water-filling.

    ``total``: words to share, by default all words; more than ``epochs`` times all words cannot be
    shared, every source is then at its cap. Each round fixes every source whose share is above its cap;
    what comes to the driver are two sums.
    """
    cap = F.col("source_size") * F.lit(float(epochs))
    first = sources.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    words = float(first["s"] or 0) if total is None else float(total)
    level = words / first["w"] if first["w"] else 0.0
    while True:
        # A source above its cap at this level stays there, for the level only rises.
        above = cap < F.col("weight") * F.lit(level)
        r = sources.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("fixed"),
                        F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not r["open"]:
            break
        risen = max(level, (words - r["fixed"]) / r["open"])
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def _walk(sized: DataFrame, open_sources: DataFrame) -> DataFrame:
    """One step of the walk: name, left, lo, most, border, taken for each of ``open_sources`` (name, left, lo) with documents that fit.

    ``sized``: source, size, top (number of its cell). Of the documents from cell ``lo`` on with at most ``most`` = floor(left) words, those
    before cell ``border`` are taken: the first cell with which they would be too much, or the end. At most 4,096 cells per source stand in a window.
    """
    most = F.floor("left").cast("long")
    fit = (sized.join(small(open_sources), F.col("source").eqNullSafe(F.col("name")))
           .filter((F.col("top") >= F.col("lo")) & (F.col("size") > 0) & (F.col("size") <= most)))

    def over(cells: DataFrame, cell: str, base: Column) -> DataFrame:
        """Per source the first cell that passes ``left``, if any, and what stands before it."""
        run = base + F.sum("size").over(Window.partitionBy("name").orderBy(cell))
        first = F.min(F.when(F.col("run") > F.col("left"), F.struct(cell, (F.col("run") - F.col("size")).alias("before")))).alias("m")
        return (cells.withColumn("run", run).groupBy("name", "left", "lo").agg(first, F.max("run").alias("all"))
                .select("name", "left", "lo", F.col(f"m.{cell}").alias("border"), F.coalesce("m.before", "all").alias("taken")))

    c0 = F.shiftright("top", BITS)
    coarse = stored(over(fit.groupBy("name", "left", "lo", c0.alias("c0")).agg(F.sum("size").alias("size")), "c0", F.lit(0)))
    at = coarse.filter("border IS NOT NULL").select(F.col("name").alias("in_name"), F.col("border").alias("in_c0"), F.col("taken").alias("before"))
    inner = (fit.join(small(at), F.col("name").eqNullSafe(F.col("in_name")) & (c0 == F.col("in_c0")))
             .groupBy("name", "left", "lo", "before", "top").agg(F.sum("size").alias("size")))
    fine = over(inner, "top", F.col("before"))
    end = F.lit(1 << 2 * BITS).cast("long")
    whole = coarse.filter("border IS NULL").select("name", "left", "lo", end.alias("border"), "taken")
    return stored(whole.unionByName(fine.select("name", "left", "lo", F.col("border").cast("long").alias("border"), "taken"))
                  .select("name", "left", "lo", most.alias("most"), "border", "taken"))


def takes(sized: DataFrame, weights=WEIGHTS, epochs: float = EPOCHS, total: float | None = None) -> DataFrame:
    """Per source: source, source_size, target, whole (repetitions of each document), picks (array of lo, hi, most).

    ``sized``: source, size (words), h (seeded hash of the document), stored. A document is taken ``whole`` times, and once more if the top
    24 bits of its hash lie in [lo, hi) of a pick and it has at most ``most`` words. The walk ends after ``STEPS`` steps, or when nothing
    open fits; until then a source misses its target by less than its smallest document behind the last border.
    """
    sized = sized.select("source", "size", F.shiftrightunsigned("h", 64 - 2 * BITS).alias("top"))
    sources = stored(with_weights(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aims = stored(targets(sources, epochs, total)
                  .withColumn("whole", F.floor(share + F.lit(1e-9)).cast("long"))
                  .withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
                  .withColumnRenamed("source", "name"))
    walk = stored(aims.filter("rest >= 1").select("name", F.col("rest").alias("left"), F.lit(0).cast("long").alias("lo")))
    picks = aims.select("name", F.lit(None).cast("struct<lo:long,hi:long,most:long>").alias("pick")).limit(0)
    for _ in range(STEPS):
        if walk.isEmpty():
            break
        step = _walk(sized, walk)
        picks = picks.unionByName(step.filter("taken > 0").select("name", F.struct("lo", F.col("border").alias("hi"), "most").alias("pick")))
        # A border cell that is too much even alone is passed by.
        on = F.when(F.col("taken") > 0, F.col("border")).otherwise(F.col("border") + 1)
        walk = stored(step.select("name", (F.col("left") - F.col("taken")).alias("left"), on.alias("lo"))
                      .filter(f"left >= 1 AND lo < {1 << 2 * BITS}"))
    picked = picks.groupBy(F.col("name").alias("pick_name")).agg(F.array_sort(F.collect_list("pick")).alias("picks"))     # STEPS at most
    return stored(aims.join(picked, F.col("name").eqNullSafe(F.col("pick_name")), "left")
                  .select(F.col("name").alias("source"), "source_size", "target", "whole", "picks"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights=WEIGHTS,
        epochs: float = EPOCHS, seed: int = SEED, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, source_size, target (of its source), copies, taken = copies * size.

    Null texts have size 0; a null source is a source, last in order. Rows that are equal in id and text (and copies with null ids) have one
    hash and are taken alike, so a source that consists mostly of one repeated row may miss its target by these rows. Columns of ``docs`` with the new names are replaced. The same rows and seed give
    the same mix, whatever their order.
    """
    new = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    h = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))
    sized = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(kept)], F.col(source).alias("source"),
                        word_count(F.col(text)).alias("size"), h.alias("h"))
    if keep is None:     # whole rows go through: words are counted twice, rather than all texts stored
        plan = takes(stored(sized.select("source", "size", "h")), weights, epochs)
    else:
        sized = stored(sized)
        plan = takes(sized, weights, epochs)
    plan = plan.withColumnRenamed("source", "plan_source")
    top = F.shiftrightunsigned("h", 64 - 2 * BITS)
    once = F.exists("picks", lambda p: (top >= p["lo"]) & (top < p["hi"]) & (F.col("size") <= p["most"]))
    copies = F.col("whole") + F.coalesce(once, F.lit(False)).cast("long")
    # The copies first: beside the new names a lambda would see those of the kept columns.
    return (sized.join(small(plan), F.col("source").eqNullSafe(F.col("plan_source"))).withColumn("__copies", copies)
            .select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(kept)], "size", "source_size", "target",
                    F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken")))


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row of ``mixed`` as often as ``copies`` says, columns ``columns``."""
    return (mixed.filter("copies > 0").withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*columns))
