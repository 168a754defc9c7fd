"""Structured Streaming jobs.

Every job writes through ``foreachBatch`` into one folder per batch id, so a batch that is
replayed after a failure overwrites its own output and changes nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sparklore.functions import text as tx
from sparklore.operators import compile as cp
from sparklore.operators import facts as fct
from sparklore.operators import incremental as inc
from sparklore.operators import memory as mem
from sparklore.session import settings
from sparklore.sources.delta_log import DeltaLog

# Attempts before the dead letter, idle time of a session memory in ms.
MAX_ATTEMPTS = 3
MEMORY_TTL_MS = 7 * 24 * 3600 * 1000


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None,
               fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass":
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def run_available(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str,
                  mode: str = "append", conf: dict[str, str] | None = None) -> None:
    """Process everything there is and stop; with another trigger the same job runs for good.

    ``conf``: settings of this query alone, as ``ROCKSDB`` for operators with state variables and timers.
    """
    with settings(stream.sparkSession, conf or {}):
        query = (stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()


def batch_folder(path: str, batch_id: int) -> str:
    return f"{path}/batch_id={batch_id}"


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(batch_folder(path, batch_id))


def compile_stream(docs: DataFrame, out: str, target: int = tx.CHUNK_TARGET, hard_max: int = tx.CHUNK_MAX,
                   compact_every: int = 16) -> None:
    """New documents are redacted, cut into chunks and spans; only new or changed chunks are written.

    The newest hash of each chunk is kept in a log bucketed by document, of which a batch reads the buckets of its
    documents and to which it adds its chunks. ``audit`` gets one row per document with something redacted.
    """
    log = DeltaLog(docs.sparkSession, f"{out}/manifest", "tenant_id string, document_id string, chunk_id string, content_hash string",
                   ["tenant_id", "document_id"], ["tenant_id", "document_id", "chunk_id"])

    def handle(batch: DataFrame, batch_id: int) -> None:
        clean = cp.redact_documents(batch.select("tenant_id", "document_id", "content")).persist()
        audit = clean.filter("hits > 0").select("tenant_id", F.col("document_id").alias("target"), F.lit("redact").alias("action"), "hits")
        write_batch(audit, f"{out}/audit", batch_id)
        # A batch that is replayed after its commit compares with itself, finds nothing new and must not overwrite its rows.
        if not any(c["batch_id"] == batch_id for c in log.commits()):
            docs_of = clean.select("tenant_id", "document_id").distinct()
            prev = log.read(docs_of).join(docs_of, ["tenant_id", "document_id"], "left_semi").select("tenant_id", "chunk_id", "content_hash")
            chunks = inc.to_compile(cp.compile_chunks(clean.drop("hits"), target=target, hard_max=hard_max), prev).drop("prev_hash")
            write_batch(chunks, f"{out}/chunks", batch_id)
            written = batch.sparkSession.read.schema(chunks.schema).parquet(batch_folder(f"{out}/chunks", batch_id))
            write_batch(cp.compile_spans(written), f"{out}/spans", batch_id)
            log.append(written, batch_id)
        clean.unpersist()
        if batch_id % compact_every == compact_every - 1:
            log.compact()

    run_available(docs, handle, f"{out}/_checkpoint")


def deduplicate(messages: DataFrame, ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """The first of equal (tenant, unit, input hash) messages within the watermark delay."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["tenant_id", "unit_id", "input_hash"])


def route_failures(failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(retries with the attempt raised, dead letters with the level that failed)."""
    last = F.col("attempt") + 1 >= MAX_ATTEMPTS
    retry = failed.filter(~last).withColumn("attempt", F.col("attempt") + 1)
    dead = failed.filter(last).withColumn("failed_level", F.col("level"))
    return retry, dead


def retry_stream(failed: DataFrame, out: str) -> None:
    def handle(batch: DataFrame, batch_id: int) -> None:
        retry, dead = route_failures(batch)
        write_batch(retry, f"{out}/retry", batch_id)
        write_batch(dead, f"{out}/dead", batch_id)
    run_available(failed, handle, f"{out}/_checkpoint")


TURN_OUT = T.StructType([
    T.StructField("tenant_id", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("session_id", T.StringType()), T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("pos", T.LongType())])


class RollingTurns(StatefulProcessor):
    """Keeps the newest turns of a session; state expires after the idle time."""

    def __init__(self, keep: int = mem.MAX_TURNS, ttl_ms: int = MEMORY_TTL_MS):
        self.keep, self.ttl_ms = keep, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = {t[0]: tuple(t) for t in self.turns.get()}
        for pdf in rows:
            kept.update({int(r.turn): (int(r.turn), r.role, r.text) for r in pdf.itertuples(index=False)})
            kept = dict(sorted(kept.items())[-self.keep:])  # never more than one batch plus the kept turns
        newest = list(kept.values())
        self.turns.put(newest)
        yield pd.DataFrame([(*key, *t, i + 1) for i, t in enumerate(newest)], columns=TURN_OUT.fieldNames())

    def close(self) -> None:
        pass


def session_memory(turns: DataFrame, keep: int = mem.MAX_TURNS) -> DataFrame:
    """The rolling memory of every session touched by a batch, as it is after the batch."""
    return turns.groupBy(*mem.SESSION).transformWithStateInPandas(
        statefulProcessor=RollingTurns(keep), outputStructType=TURN_OUT, outputMode="Update",
        timeMode="ProcessingTime")


def session_memory_stream(turns: DataFrame, out: str, keep: int = mem.MAX_TURNS) -> None:
    """Session memory of everything there is.

    State with a time to live asks for batches without data for as long as the query runs, so
    a run to the end of the input must do without them; expired turns leave with the next batch.
    """
    run_available(session_memory(turns, keep), lambda b, i: write_batch(b, f"{out}/turns", i), f"{out}/_checkpoint", "update",
                  ROCKSDB | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"})


def newest_batch(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the last batch that wrote each key."""
    last = df.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return df.join(last, [*keys, "batch_id"], "left_semi")


#: Columns of the fact table that arrivals may lack, and the values of an empty table.
FACT_STATE = {"source_count": "CAST(0 AS BIGINT)", "last_confirmed": "CAST(0 AS DOUBLE)", "retention": "CAST(1 AS DOUBLE)",
              "stale": "false", "superseded_by": "CAST(NULL AS STRING)"}


#: Batches after which the deltas of the fact log are folded into its base.
COMPACT_EVERY = 16


def fact_log(arrivals: DataFrame, out: str, buckets: int = 32) -> DeltaLog:
    """The fact table of ``reinforce_stream`` below ``out``: bucketed by group, one row per fact; all columns of the arrivals and those of ``FACT_STATE``."""
    state = {c: F.expr(e) for c, e in FACT_STATE.items()}
    empty = arrivals.sparkSession.createDataFrame([], arrivals.schema).drop(*state, "seq").withColumns(state)
    keys = [f"{k} string" for k in fct.GROUP if k not in empty.columns]
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in empty.dtypes), *keys])
    return DeltaLog(arrivals.sparkSession, f"{out}/facts", ddl, fct.GROUP, ["tenant_id", "fact_id"], buckets)


def reinforce_stream(arrivals: DataFrame, out: str, now: float, compact_every: int = COMPACT_EVERY) -> DeltaLog:
    """Reinforce facts by triple, then supersede in the groups the batch touched. All columns of the arrivals stay.

    A batch reads the buckets of its groups from the log and writes the facts that it changed, so its bytes follow
    the batch; the log knows the ids of its batches, so a replayed one does not count its arrivals twice.
    """
    log = fact_log(arrivals, out)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Read again from its source where it is needed twice: a copy of the whole batch would fill the disks of the executors.
        columns = [c for c in log.columns if c not in ("_deleted", "subject_key", "predicate_key")]
        if log.exists():
            touched = fct.with_keys(batch).select(*fct.GROUP).distinct()
            base = log.read(touched).join(touched, fct.GROUP, "left_semi").select(*columns)
        else:           # stated, so that nothing is moved to meet it
            base = log.read().limit(0).select(*columns)
        # Every group of these rows is touched. What changed is marked on the way, so results are not compared with the base.
        changed = fct.check_in_place(fct.reinforced_rows(base, batch, now), now).filter("_changed").select(*columns)
        log.append(fct.with_keys(changed), batch_id)
        if batch_id % compact_every == compact_every - 1:
            log.compact()

    run_available(arrivals, handle, f"{out}/_checkpoint")
    return log


def session_ends(turns: DataFrame, keys: list[str], ts: str = "ts", gap: str = "30 minutes",
                 delay: str = "1 hour") -> DataFrame:
    """Closed sessions of event time: start, last event and number of events."""
    return (turns.withWatermark(ts, delay).groupBy(*keys, F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("n_events"), F.max(ts).alias("last_event"))
            .select(*keys, F.col("w.start").alias("session_start"), "last_event", "n_events"))


def windowed_metrics(events: DataFrame, labels: list[str], ts: str = "ts", value: str = "v", window: str = "1 hour",
                     slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts, sum and latency buckets per label set and time window."""
    from sparklore.operators.governance import LATENCY_BUCKETS
    v = F.col(value)
    return (events.withWatermark(ts, delay).groupBy(*labels, F.window(ts, window, slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("total"),
                 *[F.count_if(v <= b).alias(f"le_{i}") for i, b in enumerate(LATENCY_BUCKETS)])
            .select(*labels, F.col("w.start").alias("window_start"), "n", "total",
                    *[f"le_{i}" for i in range(len(LATENCY_BUCKETS))]))


LEVEL_OUT = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("level", T.StringType()), T.StructField("expected", T.LongType()),
    T.StructField("done", T.LongType()), T.StructField("outcome", T.StringType())])


class LevelCompletion(StatefulProcessor):
    """Counts the finished units of a level. Reports once, when all are there or when nothing has come for the idle time, and forgets the level."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "done long, expected long, timer long")

    def _report(self, key, done: int, expected: int | None, outcome: str) -> Iterator[Row]:
        yield Row(job_id=key[0], level=key[1], expected=expected, done=done, outcome=outcome)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each call on state or timers asks the JVM, so a level that is whole in its first batch makes one call.
        done, expected, timer = self.count.get() or (0, None, None)
        latest = 0
        for row in rows:
            done += 1
            expected = row.expected if row.expected is not None else expected
            latest = max(latest, row.at_ms)
        due = max(timer or 0, latest + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1)
        complete = expected is not None and done >= expected
        if timer is not None and (complete or due != timer):
            self.handle.deleteTimer(timer)
        if complete:
            if timer is not None:
                self.count.clear()
            yield from self._report(key, done, expected, "complete")
            return
        if due != timer:
            self.handle.registerTimer(due)
        self.count.update((done, expected, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        done, expected, _ = self.count.get()
        self.count.clear()
        yield from self._report(key, done, expected, "abandoned")

    def close(self) -> None:
        pass


def level_progress(done: DataFrame, expected: DataFrame, ts: str = "ts", idle: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """job_id, level, expected, done, outcome: each level once, ``complete`` or ``abandoned``; after that it has no state.

    ``done``: stream of finished units (job_id, level, event time). ``expected``: static (job_id, level, expected). A level
    without an expected number can only be abandoned. Repeated messages are dropped before, by ``deduplicate``.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    units = done.withWatermark(ts, delay).join(expected.select("job_id", "level", "expected"), ["job_id", "level"], "left")
    return (units.withColumn("at_ms", F.unix_millis(ts)).groupBy("job_id", "level")
            .transformWithState(statefulProcessor=LevelCompletion(idle_ms), outputStructType=LEVEL_OUT,
                                outputMode="Append", timeMode="EventTime"))
