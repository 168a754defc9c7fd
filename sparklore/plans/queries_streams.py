"""Streaming jobs run to the end of their input, read back as tables."""

from pyspark.sql import functions as F

from sparklore.functions import text as tx
from sparklore.operators import incremental as inc
from sparklore.operators import memory as mem
from sparklore.plans.fixtures import NOW, Kb
from sparklore.plans.queries_answers import LAST
from sparklore.plans.queries_facts import patch_sql
from sparklore.plans.registry import query
from sparklore.sources.corpus import run_folder
from sparklore.streaming import jobs

R = F.round


class LiveKb(Kb):
    """The same knowledge tables over a file stream of the driver tables, which arrive in three parts.

    The parts are written one after the other to a run folder, each in as many files as the table has, and read one part per batch
    in order of a key, so state, changes and sessions cross batches.
    """

    order = {"conversations": "turn"}

    def parts(self, name, whole):
        key = F.col(self.order.get(name, whole.columns[0]))
        low, high = whole.select(F.percentile_approx(key, [0.34, 0.67])).first()[0]
        return key <= low, (key > low) & (key <= high), key > high

    def raw(self, name):
        whole = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        folder, files = run_folder(self.spark, f"arrivals_{name}"), len(whole.inputFiles())
        self.folders = getattr(self, "folders", {}) | {name: folder}
        for part in self.parts(name, whole):
            whole.filter(part).repartition(files).write.mode("append").parquet(folder)
        return jobs.read_files(self.spark, folder, whole.schema, files_per_batch=files)


class LiveKbInThirds(LiveKb):
    """Line items arrive in three batches by the remainder of their line number."""

    def parts(self, name, whole):
        return [F.col("l_linenumber") % 3 == b for b in range(3)]


class LiveKbClosed(LiveKb):
    """Events in order of time, and behind them one row long after all others: the watermark passes everything before it."""

    order = {"events": "ts", "lineitem": "l_shipdate"}
    later = {"events": ["event_id", "user_id"], "lineitem": ["l_orderkey"]}

    def raw(self, name):
        stream = super().raw(name)
        whole = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        ts = self.order[name]
        last = whole.orderBy(F.desc(ts)).limit(1).withColumn(ts, F.col(ts) + F.expr("INTERVAL '40' YEAR"))
        last = last.withColumns({c: F.lit(-1).cast(whole.schema[c].dataType) for c in self.later[name]})
        last.select(whole.columns).write.mode("append").parquet(self.folders[name])
        return stream


class LiveKbAtOnce(Kb):
    """One batch: for results that depend on what has arrived before."""

    def raw(self, name):
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return jobs.read_files(self.spark, self.sf_dir, schema, f"{name}.parquet")


def live(kb):
    return LiveKb(kb.spark, kb.sf_dir)


def collected(kb, stream, name, mode="append", keys=None, conf=None):
    """Run a stream into batch folders and read the result table."""
    out = run_folder(kb.spark, name)
    jobs.run_available(stream, lambda b, i: jobs.write_batch(b, f"{out}/rows", i), f"{out}/_checkpoint", mode, conf)
    rows = kb.spark.read.parquet(f"{out}/rows")
    return (jobs.newest_batch(rows, keys) if keys else rows).drop("batch_id")


@query("str01_compile_stream")
def _(kb):
    out = run_folder(kb.spark, "compile")
    jobs.compile_stream(live(kb).documents, out)
    return kb.spark.read.parquet(f"{out}/spans").drop("batch_id")


@query("str01_compiled_chunks", """
SELECT tenant_id, 'doc_' || doc_id AS document_id, sha256(regexp_replace(clean, '^\\s+|\\s+$', '', 'g') || chr(0) || 'v1' || chr(0)) AS content_hash
FROM (SELECT 't' || (doc_id % 4) AS tenant_id, doc_id, clean FROM kb_redacted) WHERE trim(clean) <> ''""")
def _(kb):
    out = run_folder(kb.spark, "compile")
    jobs.compile_stream(live(kb).documents, out)
    return kb.spark.read.parquet(f"{out}/chunks").select("tenant_id", "document_id", "content_hash")


@query("str01_redaction_audit", """
SELECT 't' || (doc_id % 4) AS tenant_id, 'doc_' || doc_id AS target, 'redact' AS action, hits FROM kb_redacted WHERE hits > 0""")
def _(kb):
    out = run_folder(kb.spark, "compile")
    jobs.compile_stream(live(kb).documents, out)
    return kb.spark.read.parquet(f"{out}/audit").select("tenant_id", "target", "action", F.col("hits").cast("long").alias("hits"))


def messages(kb):
    """Compile messages of every event: the unit is the user, the hash its action."""
    return kb.raw("events").select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"),
        tx.cat("u", F.col("user_id")).alias("unit_id"), F.col("event_type").alias("input_hash"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id"), F.col("value"))


@query("str02_deduplicate", """
SELECT DISTINCT 't' || (user_id % 4) AS tenant_id, 'u' || user_id AS unit_id, event_type AS input_hash FROM events""")
def _(kb):
    stream = jobs.deduplicate(messages(live(kb)), delay="3650 days")
    return collected(kb, stream, "dedup").select("tenant_id", "unit_id", "input_hash")


def failures(kb):
    return messages(kb).filter("input_hash = 'error'").withColumns({
        "level": F.lit("L2"), "attempt": F.pmod(F.col("event_id"), F.lit(4)).cast("int")}).drop("ts")


@query("str03_retry_or_dead", """
SELECT event_id, CASE WHEN event_id % 4 + 1 >= 3 THEN 'dead' ELSE 'retry' END AS route,
       CAST(CASE WHEN event_id % 4 + 1 >= 3 THEN event_id % 4 ELSE event_id % 4 + 1 END AS INTEGER) AS attempt
FROM events WHERE event_type = 'error'""")
def _(kb):
    out = run_folder(kb.spark, "retry")
    jobs.retry_stream(failures(live(kb)), out)
    return kb.spark.read.parquet(f"{out}/retry").select("event_id", F.lit("retry").alias("route"), "attempt").unionByName(
        kb.spark.read.parquet(f"{out}/dead").select("event_id", F.lit("dead").alias("route"), "attempt"))


@query("str04_session_memory", "WITH " + LAST.format(k=20) + """
SELECT tenant_id, session_id, turn, role, CAST(least(n, 20) - back + 1 AS BIGINT) AS pos FROM last""")
def _(kb):
    out = run_folder(kb.spark, "memory")
    jobs.session_memory_stream(live(kb).turns.select(*mem.SESSION, "turn", "role", "text"), out)
    rows = jobs.newest_batch(kb.spark.read.parquet(f"{out}/turns"), mem.SESSION)
    return rows.select("tenant_id", "session_id", "turn", "role", "pos")


def reinforced(batches: list[str]) -> str:
    """The fact table after batches of arrivals (conditions on kb_facts), one chained step per batch."""
    steps = ["""
st0 AS (SELECT tenant_id, fact_id, lower(subject_entity) AS s, lower(predicate) AS p, lower(object_value) AS o, 0::BIGINT AS source_count,
               false AS stale, NULL::VARCHAR AS superseded_by FROM kb_facts WHERE false)"""]
    for i, where in enumerate(batches):
        steps.append(f"""
g{i} AS (SELECT tenant_id, lower(subject_entity) AS s, lower(predicate) AS p, lower(object_value) AS o, count(*) AS n, min(fact_id) AS fact_id
         FROM kb_facts WHERE {where} GROUP BY 1, 2, 3, 4),
me{i} AS (SELECT t.tenant_id, t.fact_id, s, p, o, source_count + coalesce(g.n, 0) AS source_count, stale, superseded_by
          FROM st{i} t LEFT JOIN (SELECT tenant_id, s, p, o, n FROM g{i}) g USING (tenant_id, s, p, o)
          UNION ALL SELECT tenant_id, fact_id, s, p, o, n, false, NULL FROM g{i} ANTI JOIN st{i} USING (tenant_id, s, p, o)),
li{i} AS (SELECT * FROM me{i} SEMI JOIN g{i} USING (tenant_id, s, p) WHERE NOT stale),
pa{i} AS (SELECT tenant_id, fact_id, winner FROM (
            SELECT tenant_id, fact_id, min(o) OVER q <> max(o) OVER q AS torn,
                   first_value(fact_id) OVER (PARTITION BY tenant_id, s, p ORDER BY source_count DESC, fact_id) AS winner
            FROM li{i} WINDOW q AS (PARTITION BY tenant_id, s, p)) WHERE torn AND fact_id <> winner),
st{i + 1} AS (SELECT tenant_id, fact_id, s, p, o, source_count, stale OR winner IS NOT NULL AS stale, coalesce(winner, superseded_by) AS superseded_by
              FROM me{i} LEFT JOIN pa{i} USING (tenant_id, fact_id))""")
    return f"WITH {','.join(steps)}\nSELECT tenant_id, fact_id, source_count, stale, superseded_by FROM st{len(batches)}"


def reinforce(kb, arrivals, **kw):
    out = run_folder(kb.spark, "facts")
    log = jobs.reinforce_stream(arrivals.withColumn("seq", F.col("fact_id")), out, NOW, **kw)
    return log.read().select("tenant_id", "fact_id", "source_count", "stale", "superseded_by")


@query("str05_reinforce_stream", reinforced(["true"]))
def _(kb):
    return reinforce(kb, LiveKbAtOnce(kb.spark, kb.sf_dir).facts)


@query("str05_reinforce_over_batches", reinforced([f"source_count % 3 = {b}" for b in range(3)]))
def _(kb):
    """All facts in three batches; groups and triples cross them, and the log is compacted between."""
    return reinforce(kb, LiveKbInThirds(kb.spark, kb.sf_dir).facts, compact_every=2)


@query("str06_session_ends", """
SELECT tenant_id, unit_id, count(*) AS n_events, min(stamp) AS session_start FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY unit_id ORDER BY ts) AS sess_no FROM (
    SELECT 't' || (user_id % 4) AS tenant_id, 'u' || user_id AS unit_id, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp,
           CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events))
GROUP BY tenant_id, unit_id, sess_no""")
def _(kb):
    ends = jobs.session_ends(messages(LiveKbClosed(kb.spark, kb.sf_dir)), ["tenant_id", "unit_id"])
    return collected(kb, ends, "sessions").select(
        "tenant_id", "unit_id", "n_events", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"))


METRICS = """
SELECT input_hash, strftime(time_bucket(INTERVAL {size}, ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(sum(v), 4) AS total,
       count(*) FILTER (v <= 1) AS le_2, count(*) FILTER (v <= 10) AS le_5
FROM (SELECT event_type AS input_hash, ts, value / 10 AS v FROM events) GROUP BY 1, 2"""


@query("str07_windowed_metrics", METRICS.format(size="'1 hour'"))
def _(kb):
    events = messages(LiveKbClosed(kb.spark, kb.sf_dir)).withColumn("v", F.col("value") / 10)
    rows = collected(kb, jobs.windowed_metrics(events, ["input_hash"]), "metrics")
    return rows.select("input_hash", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n",
                       R("total", 4).alias("total"), "le_2", "le_5")


@query("str07_sliding_rate", """
SELECT input_hash, strftime(start, '%Y-%m-%d %H:%M') AS window_start, count(*) AS n, round(count(*) / 300.0, 6) AS per_second
FROM (SELECT event_type AS input_hash, ts, unnest([date_trunc('minute', ts), date_trunc('minute', ts) - INTERVAL 1 MINUTE,
        date_trunc('minute', ts) - INTERVAL 2 MINUTE, date_trunc('minute', ts) - INTERVAL 3 MINUTE,
        date_trunc('minute', ts) - INTERVAL 4 MINUTE]) AS start FROM events) GROUP BY 1, 2""")
def _(kb):
    events = messages(LiveKbClosed(kb.spark, kb.sf_dir)).withColumn("v", F.col("value") / 10)
    rows = collected(kb, jobs.windowed_metrics(events, ["input_hash"], window="5 minutes", slide="1 minute"), "rate")
    return rows.select("input_hash", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "n",
                       R(F.col("n") / 300.0, 6).alias("per_second"))


@query("str08_level_progress", """
SELECT 'j' || l_orderkey AS job_id, l_linestatus AS level, count(*) AS expected, count(*) FILTER (l_returnflag <> 'N') AS done,
       CASE WHEN count(*) FILTER (l_returnflag <> 'N') >= count(*) THEN 'complete' ELSE 'abandoned' END AS outcome
FROM lineitem GROUP BY 1, 2 HAVING count(*) FILTER (l_returnflag <> 'N') > 0""")
def _(kb):
    """Line items that were accepted or returned are finished units; the others never come."""
    def units(k):
        return k.raw("lineitem").select(tx.cat("j", F.col("l_orderkey")).alias("job_id"), F.col("l_linestatus").alias("level"),
                                        "l_returnflag", F.col("l_shipdate").cast("timestamp").alias("ts"))
    want = units(kb).groupBy("job_id", "level").agg(F.count(F.lit(1)).alias("expected"))
    done = units(LiveKbClosed(kb.spark, kb.sf_dir)).filter("l_returnflag <> 'N' OR job_id = 'j-1'")
    return collected(kb, jobs.level_progress(done, want, idle="3650 days"), "levels", conf=jobs.ROCKSDB).filter("job_id <> 'j-1'")
