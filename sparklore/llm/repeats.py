"""Removal of long byte strings that repeat anywhere in the corpus, by suffix arrays of shards (op 5).

A byte goes if a string of ``WIDTH`` bytes that covers it starts at another place too, in the same document or in
another. The corpus is too large for one suffix array, so its windows of ``WIDTH`` bytes are dealt to shards in such a way that
equal windows always meet:

1. Anchors. The anchor of a window is its leftmost ``GRAM``-byte string with the smallest hash; equal windows have equal
   anchors at equal places. Consecutive windows share theirs, about one anchor per 190 bytes. Anchors
   that occur once in the corpus cannot belong to a repeated window and go.
2. Contexts. What remains of a document are contexts: the bytes of consecutive windows with one anchor. Equal contexts
   are counted, and one of them goes on with its number, so a group of copies weighs as little as two.
3. Shards. The contexts of an anchor go to one shard. A shard sorts all suffixes of its contexts by induced sorting and computes
   the common prefixes: a window repeats if the suffix before or after it shares ``WIDTH`` bytes or more, or if its context
   occurs twice.
4. An anchor with more than ``CROWD`` different contexts (the edge of a passage that very many documents share) is split first: its
   windows are cut into blocks at equal distances from the anchor, and the bytes that all windows of a block
   share become the new anchor. A block whose anchor is unique goes; blocks of one window have one context per
   anchor. So shards stay small however hot a passage is, and nothing is lost.

The windows found travel back to their documents as numbers. Hashes only bring windows together or count equal contexts (128 bits);
whether windows are equal is read off the suffix arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklore.llm.common import stored, with_arrow
from sparklore.llm.sais import permuted_common_prefixes, suffix_array

WIDTH, GRAM = 400, 32
#: Different contexts of an anchor beyond which it is split; sizes of the blocks, in windows, from level to level.
CROWD, BLOCKS = 500, (64, 8, 1)
#: Bytes worked on at once: texts in the search for anchors, contexts in a suffix array.
STEP, SHARD = 1 << 21, 1 << 21
_PLACE = np.uint64((1 << 22) - 1)
_ODD = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def anchors(data: np.ndarray, powers: tuple[np.ndarray, np.ndarray], width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window start of ``data``: place of its anchor; and of each place the hash of its ``gram`` bytes."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * powers[0][:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * powers[1][:n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(_ODD)
    h ^= h >> np.uint64(29)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)    # ties: the leftmost
    span, size = width - gram + 1, 1
    starts = n - width + 1
    while size * 2 <= span:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    best = np.minimum(key[:starts], key[span - size:span - size + starts])
    return (best & _PLACE).astype(np.int64), h


def _contexts_of(texts: list[bytes], width: int, gram: int) -> list[np.ndarray]:
    """Of each context of some texts: number of the text, anchor hash, context hash (two halves), first window, windows, distance of the anchor."""
    out = [[] for _ in range(7)]
    size = max(STEP + width, 2 * width)
    powers = (_powers(_BASE, size + 1), _powers(_INVERSE, size + 1))

    def work(block: list[tuple[int, int, bytes]]) -> None:
        joined = b"".join(b for _, _, b in block)
        data = np.frombuffer(joined, np.uint8)
        place, h = anchors(data, powers, width, gram)
        lengths = np.array([len(b) for _, _, b in block])
        begin = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(block)), lengths)[:len(place)]
        own = np.arange(len(place)) + width <= (begin + lengths)[owner]      # windows inside one text
        first = own.copy()
        first[1:] &= (place[1:] != place[:-1]) | ~own[:-1] | (owner[1:] != owner[:-1])
        lo = np.flatnonzero(first)
        stop = ~own.copy()
        stop[first] = True
        stops = np.append(np.flatnonzero(stop), len(place))
        hi = stops[np.searchsorted(stops, lo, "right")]                      # first window that is not in the context
        digest = xxhash.xxh3_128_digest
        hashes = np.frombuffer(b"".join([digest(joined[a:b]) for a, b in zip(lo.tolist(), (hi + width - 1).tolist())]), np.int64)
        who = owner[lo]
        number, shift = np.array([x for x, _, _ in block]), np.array([x for _, x, _ in block])
        for o, x in zip(out, (number[who], h[place[lo]].view(np.int64), hashes[0::2], hashes[1::2],
                              lo - begin[who] + shift[who], hi - lo, place[lo] - lo)):
            o.append(x)

    block, room = [], STEP
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - width + 1), STEP):             # a long text in parts of STEP windows
            part = text[at:at + STEP + width - 1]
            if len(part) < width:
                continue
            if len(part) > room and block:
                work(block)
                block, room = [], STEP
            block.append((i, at, part))
            room -= len(part)
    if block:
        work(block)
    return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def repeated_windows(contexts: list[bytes], often: np.ndarray, width: int) -> list[list[tuple[int, int]]]:
    """Of each context its runs of repeated windows (first, last). ``often``: does the context occur twice?"""
    lengths = np.array([len(c) + 1 for c in contexts])
    begin = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)        # a byte that UTF-8 does not have
    order = suffix_array(data)
    prefix, before = permuted_common_prefixes(data, order)
    hit = prefix >= width
    found = hit.copy()
    found[before[hit]] = True
    owner = np.repeat(np.arange(len(contexts)), lengths)
    found |= often[owner]
    found &= np.arange(len(data)) + width < (begin + lengths)[owner]          # windows inside one context
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    runs: list[list[tuple[int, int]]] = [[] for _ in contexts]
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()):
        i = owner[a]
        runs[i].append((a - int(begin[i]), b - int(begin[i])))
    return runs


RUNS = "array<struct<first:int,last:int>>"
_ARROW_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _shard_runs(contexts: DataFrame, width: int) -> DataFrame:
    """c1, c2, runs of contexts (anchor, c1, c2, n, bytes): one suffix array per shard of whole anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None

        def solve() -> pa.RecordBatch:
            runs = repeated_windows([r[3] for r in rows], np.array([r[2] > 1 for r in rows]), width)
            keep = [i for i, x in enumerate(runs) if x]
            return pa.RecordBatch.from_arrays(
                [pa.array([rows[i][0] for i in keep], pa.int64()), pa.array([rows[i][1] for i in keep], pa.int64()),
                 pa.array([[{"first": a, "last": b} for a, b in runs[i]] for i in keep], _ARROW_RUNS)],
                names=["c1", "c2", "runs"])

        for batch in batches:
            for anchor, c1, c2, n, data in zip(*[c.to_pylist() for c in batch.columns]):
                if size >= SHARD and anchor != last:
                    yield solve()
                    rows, size = [], 0
                rows.append((c1, c2, n, data))
                size += len(data) + 1
                last = anchor
        if rows:
            yield solve()

    dealt = contexts.select("anchor", "c1", "c2", "n", "bytes").repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, f"c1 long, c2 long, runs {RUNS}")


def _split(contexts: DataFrame, width: int, block: int) -> DataFrame:
    """Blocks of ``block`` windows of contexts: anchor, c1, c2 (of the block), p1, p2 (of the context), n, at, size.

    Blocks are counted from the anchor, which stands ``before`` bytes after the first window of a context.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(9)]
            for anchor, c1, c2, n, data, before in zip(*[c.to_pylist() for c in batch.columns]):
                lo, windows = 0, len(data) - width + 1
                while lo < windows:
                    begin = lo - (lo - before) % block              # of the whole block, even where the context lacks some
                    hi = min(windows, begin + block)
                    shared = data[begin + block - 1:begin + width]
                    new = xxhash.xxh3_64(shared, seed=(anchor + (lo - before) // block * _ODD + block) & _WRAP).intdigest()
                    c = np.frombuffer(xxhash.xxh3_128_digest(data[lo:hi + width - 1]), np.int64)
                    for o, x in zip(out, (new - (1 << 64) if new >> 63 else new, int(c[0]), int(c[1]), c1, c2, n, lo,
                                          hi - lo + width - 1, before - lo)):
                        o.append(x)
                    lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32() if i > 5 else pa.int64()) for i, o in enumerate(out)],
                                             names=["anchor", "c1", "c2", "p1", "p2", "n", "at", "size", "before"])
    return contexts.select("anchor", "c1", "c2", "n", "bytes", "before").mapInArrow(
        run, "anchor long, c1 long, c2 long, p1 long, p2 long, n long, at int, size int, before int")


def _solve(contexts: DataFrame, width: int, level: int = 0) -> DataFrame:
    """c1, c2, runs of stored contexts; crowded anchors are split first."""
    if level == len(BLOCKS):
        return _shard_runs(contexts, width)
    crowded = stored(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > CROWD).select("anchor"))
    if crowded.isEmpty():
        return _shard_runs(contexts, width)
    few = _shard_runs(contexts.join(crowded, "anchor", "left_anti"), width)
    many = stored(contexts.join(crowded, "anchor", "left_semi").select(*contexts.columns))
    blocks = stored(_split(many, width, BLOCKS[level]))
    twice = stored(blocks.groupBy("anchor").agg(F.sum("n").alias("k")).filter(F.col("k") > 1).select("anchor"))
    blocks = stored(blocks.join(twice, "anchor", "left_semi"))
    one = (blocks.groupBy("anchor", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("p1", "p2", "at", "size", "before")).alias("m"))
           .select("anchor", "c1", "c2", "n", F.col("m.p1").alias("p1"), F.col("m.p2").alias("p2"), F.col("m.at").alias("at"),
                   F.col("m.size").alias("size"), F.col("m.before").alias("before")))
    source = many.select(F.col("c1").alias("p1"), F.col("c2").alias("p2"), "bytes")
    inner = stored(one.join(source, ["p1", "p2"])
                   .select("anchor", "c1", "c2", "n", F.substring("bytes", F.col("at") + 1, F.col("size")).alias("bytes"), "before"))
    solved = stored(_solve(inner, width, level + 1))
    back = (blocks.select("c1", "c2", "p1", "p2", "at").join(solved, ["c1", "c2"])
            .select("p1", "p2", F.explode(F.transform("runs", lambda r: F.struct(
                (r["first"] + F.col("at")).alias("first"), (r["last"] + F.col("at")).alias("last")))).alias("run"))
            .groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(F.sort_array(F.collect_list("run")).alias("runs")))
    return few.union(back)


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """key_id, key_hash (xxhash64 of the text), runs (first and last window) of the rows of ``docs`` that have repeated windows."""
    rows = docs.select(F.col(doc_id).cast("long").alias("key_id"), F.xxhash64(F.col(text)).alias("key_hash"),
                       F.col(text).cast("binary").alias("bytes")).filter(F.octet_length("bytes") >= width)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, texts = (c.to_pylist() for c in batch.columns)
            who, anchor, c1, c2, at, windows, before = _contexts_of(texts, width, gram)
            key = [pa.array(x, pa.int64()).take(pa.array(who)) for x in (ids, hashes)]
            yield pa.RecordBatch.from_arrays([*key, pa.array(anchor), pa.array(c1), pa.array(c2),
                                              *[pa.array(x.astype(np.int32)) for x in (at, windows, before)]],
                                             names=["key_id", "key_hash", "anchor", "c1", "c2", "at", "windows", "before"])

    found = stored(rows.mapInArrow(find, "key_id long, key_hash long, anchor long, c1 long, c2 long, at int, windows int, before int"))
    twice = stored(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("anchor"))
    found = stored(found.join(twice, "anchor", "left_semi"))
    one = (found.groupBy("anchor", "c1", "c2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key_id", "key_hash", "at", "windows", "before")).alias("m"))
           .select("anchor", "c1", "c2", "n", "m.*"))
    wanted = stored(one.groupBy("key_id", "key_hash").agg(F.collect_list(F.struct("anchor", "c1", "c2", "n", "at", "windows", "before")).alias("cs"))
                    .withColumnsRenamed({"key_id": "w_id", "key_hash": "w_hash"}))
    # Rows equal in id and text bring a context twice; it counts as repeated anyway.
    texts = rows.join(wanted, F.col("key_id").eqNullSafe(F.col("w_id")) & (F.col("key_hash") == F.col("w_hash")))
    cut = (texts.select("bytes", F.explode("cs").alias("c"))
           .select("c.anchor", "c.c1", "c.c2", "c.n",
                   F.substring("bytes", F.col("c.at") + 1, F.col("c.windows") + width - 1).alias("bytes"), "c.before"))
    solved = stored(_solve(stored(cut), width))
    return stored(found.select("key_id", "key_hash", "c1", "c2", "at").join(solved, ["c1", "c2"])
                  .select("key_id", "key_hash", F.explode(F.transform("runs", lambda r: F.struct(
                      (r["first"] + F.col("at")).alias("first"), (r["last"] + F.col("at")).alias("last")))).alias("run"))
                  .groupBy("key_id", "key_hash").agg(F.collect_set("run").alias("runs")))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, gram: int = GRAM,
                   keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_bytes, spans (removed bytes, end exclusive) and kept (the remaining bytes).

    Null counts as the empty text. Texts shorter than ``width`` bytes lose nothing. Two rows are two places, even if equal. Cuts may
    fall inside a character, so ``kept`` is binary. Columns of ``docs`` with the new names are replaced.
    """
    new = {"n_bytes": "long", "spans": "array<struct<start:long,end:long>>", "kept": "binary"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    runs = repeated_runs(docs, text, doc_id, width, gram).withColumnsRenamed({"key_id": "r_id", "key_hash": "r_hash"})
    inner = docs.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(kept)], F.col(doc_id).cast("long").alias("key_id"),
                        F.xxhash64(F.col(text)).alias("key_hash"), F.col(text).cast("binary").alias("bytes"))
    both = inner.join(runs, F.col("key_id").eqNullSafe(F.col("r_id")) & (F.col("key_hash") == F.col("r_hash")), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: pa.RecordBatch) -> dict:
        n, spans, rest = [], [], []
        for data, found in zip(batch.column(0), batch.column(1)):
            data, merged = data.as_py() or b"", []
            for r in sorted((found.as_py() or []), key=lambda r: r["first"]):
                if merged and r["first"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], r["last"] + width)
                else:
                    merged.append({"start": r["first"], "end": r["last"] + width})
            borders = [0, *[x for m in merged for x in (m["start"], m["end"])], len(data)]
            n.append(len(data))
            spans.append(merged)
            rest.append(b"".join(data[a:b] for a, b in zip(borders[0::2], borders[1::2])))
        return {"n": pa.array(n, pa.int64()), "s": pa.array(spans, span), "k": pa.array(rest, pa.binary())}

    out = with_arrow(both, run, new, ["bytes", "runs"], [f"d{i}" for i in range(len(kept))])
    return out.select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(kept)], *new)
