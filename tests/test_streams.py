"""Streams over several runs: replays, changed documents, state that ends, bytes that follow the batch."""

import datetime as dt
import glob
import json
import os

from pyspark.sql import functions as F

from sparklore.operators import facts as fct
from sparklore.streaming import jobs

DOCS = "tenant_id string, document_id string, content string"
FACTS = "tenant_id string, fact_id string, subject_entity string, predicate string, object_value string, seq string"


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return jobs.read_files(spark, folder, spark.createDataFrame([], schema).schema, files_per_batch=1)


def test_only_changed_chunks_are_compiled_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, [("t", "a", "# One\n\nfirst text"), ("t", "b", "# Two\n\nmail x@example.com")], DOCS)
    jobs.compile_stream(stream(spark, src, DOCS), out)
    land(spark, src, [("t", "a", "# One\n\nsecond text"), ("t", "b", "# Two\n\nmail x@example.com"), ("t", "c", "new")], DOCS)
    jobs.compile_stream(stream(spark, src, DOCS), out, compact_every=1)
    land(spark, src, [("t", "a", "# One\n\nsecond text")], DOCS)
    jobs.compile_stream(stream(spark, src, DOCS), out)
    got = {(r.batch_id, r.document_id, r.change) for r in spark.read.parquet(f"{out}/chunks").collect()}
    assert got == {(0, "a", "new"), (0, "b", "new"), (1, "a", "changed"), (1, "c", "new")}
    audit = spark.read.parquet(f"{out}/audit").collect()
    assert {(r.batch_id, r.target, r.hits) for r in audit} == {(0, "b", 1), (1, "b", 1)}


def test_facts_of_a_batch_are_written_alone(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, src, [("t", f"f{i}", f"s{i}", "p", "x", f"{i:06d}") for i in range(5000)], FACTS)
    log = jobs.reinforce_stream(stream(spark, src, FACTS), out, 100.0, compact_every=1)

    def size():
        return {f: os.path.getsize(f) for f in glob.glob(f"{out}/facts/data/**/*.parquet", recursive=True)}
    before = size()
    land(spark, src, [("t", "g1", "S7", "P", "X", "a"), ("t", "g2", "s8", "p", "y", "b")], FACTS)
    log = jobs.reinforce_stream(stream(spark, src, FACTS), out, 200.0)
    added = sum(n for f, n in size().items() if f not in before)
    assert added < 0.05 * sum(before.values())
    rows = {r.fact_id: r for r in log.read().collect()}
    assert len(rows) == 5001 and rows["f7"].source_count == 2 and rows["f7"].last_confirmed == 200.0
    assert (rows["f8"].stale, rows["f8"].superseded_by, rows["g2"].stale) == (True, "g2", False)
    # A batch that is handled again after its commit changes nothing.
    assert not log.append(fct.with_keys(log.read().withColumn("source_count", F.lit(9).cast("long"))), 1)
    assert {r.source_count for r in log.read().collect()} == {1, 2}


def test_a_batch_of_facts_is_not_kept(spark, tmp_path, monkeypatch):
    src, out, seen, whole = str(tmp_path / "in"), str(tmp_path / "out"), [], fct.reinforced_rows

    def watched(base, batch, now):
        level = batch.storageLevel
        seen.append((level.useMemory or level.useDisk, base._jdf.queryExecution().optimizedPlan().toString()))
        return whole(base, batch, now)

    monkeypatch.setattr(fct, "reinforced_rows", watched)
    for rows in ([("t", "f1", "s", "p", "x", "a"), ("t", "f2", "s", "p", "y", "b"), (None, "f3", None, "p", "x", "c")],
                 [("t", "f4", "S", "P", "X", "d")]):
        land(spark, src, rows, FACTS)
        log = jobs.reinforce_stream(stream(spark, src, FACTS), out, 100.0)
    assert [kept for kept, _ in seen] == [False, False]
    # A log without rows is met by nothing that would have to be moved.
    assert seen[0][1].startswith("LocalRelation <empty>") and "LeftSemi" in seen[1][1]
    got = {r.fact_id: (r.source_count, r.stale, r.superseded_by) for r in log.read().collect()}
    assert got == {"f1": (2, False, None), "f2": (1, True, "f1"), "f3": (1, False, None)}


def test_levels_report_once_and_leave_no_state(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "job_id string, level string, ts timestamp"
    day = dt.datetime(2024, 1, 1)

    def at(h):
        return day + dt.timedelta(hours=h)
    want = spark.createDataFrame([("j1", "L1", 3), ("j1", "L2", 2), ("j2", "L1", 5)], "job_id string, level string, expected int")
    land(spark, src, [("j1", "L1", at(0)), ("j1", "L1", at(1)), ("j2", "L1", at(1))], schema)
    land(spark, src, [("j1", "L1", at(2)), ("j1", "L2", at(2)), ("j3", "L1", at(2))], schema)
    land(spark, src, [("j1", "L2", at(3)), ("j2", "L1", at(20))], schema)       # j2 goes on within its idle time
    query = (jobs.level_progress(stream(spark, src, schema), want).writeStream.format("parquet").option("path", f"{out}/rows")
             .option("checkpointLocation", f"{out}/cp"))

    def run():
        q = query.trigger(availableNow=True).start()
        q.awaitTermination()
        return q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    def reports():
        return sorted((r.job_id, r.level, r.expected, r.done, r.outcome) for r in spark.read.parquet(f"{out}/rows").collect())
    run()
    assert reports() == [("j1", "L1", 3, 3, "complete"), ("j1", "L2", 2, 2, "complete")]
    land(spark, src, [("j1", "L1", at(60))], schema)                           # the watermark passes every idle time
    run()
    land(spark, src, [("j9", "L1", at(500))], schema)
    run()
    assert reports() == [("j1", "L1", 3, 1, "abandoned"), ("j1", "L1", 3, 3, "complete"), ("j1", "L2", 2, 2, "complete"),
                         ("j2", "L1", 5, 2, "abandoned"), ("j3", "L1", None, 1, "abandoned")]
    states = spark.read.format("statestore").option("path", f"{out}/cp").option("stateVarName", "count").load()
    assert [json.loads(r[0])["job_id"] for r in states.select(F.to_json("key")).collect()] == ["j9"]
