"""The delta log: newest rows win, batches are written once, deltas follow the batch, compaction touches dirty buckets only."""

import glob
import os

from pyspark.sql import functions as F

from sparklore.sources.delta_log import DeltaLog

SCHEMA = "k long, g string, v string"


def rows(spark, items):
    return spark.createDataFrame([(k, f"g{k % 7}", v) for k, v in items], SCHEMA)


def files(path):
    return {f: os.path.getsize(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def state(log, **kw):
    return {r.k: r.v for r in log.read(**kw).collect()}


def test_newest_rows_win(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path), SCHEMA, ["g"], ["k"], buckets=8)
    assert state(log) == {} and log.compact() == [] and not log.exists()
    assert log.append(rows(spark, [(i, "a") for i in range(200)]), 0)
    assert log.append(rows(spark, [(3, "b"), (500, "b")]), 1)
    assert not log.append(rows(spark, [(3, "again")]), 1)
    want = {i: "a" for i in range(200)} | {3: "b", 500: "b"}
    assert state(log) == want
    log.append(rows(spark, [(4, None)]).withColumn("_deleted", F.lit(True)), 2)
    log.append(rows(spark, []), 3)
    del want[4]
    assert state(log) == want
    some = state(log, touching=spark.createDataFrame([("g3",)], "g string"))
    assert {k for k in want if k % 7 == 3} <= some.keys() < want.keys()
    assert log.compact() and state(log) == want and log.compact() == []
    # A write that dies before its commit is not read, and the next one takes its place.
    rows(spark, [(9, "lost")]).withColumns({"_deleted": F.lit(False), "_bucket": F.lit(0)}).write.partitionBy("_bucket").parquet(
        f"{tmp_path}/data/_version={log.commits()[-1]['version'] + 1}")
    assert state(log) == want
    log.append(rows(spark, [(9, "c")]), 4)
    assert state(log) == want | {9: "c"}


def test_bytes_follow_the_batch(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path), SCHEMA, ["g"], ["k"], buckets=8)
    log.append(rows(spark, [(i, f"value {i * 7919}") for i in range(20_000)]), 0)
    log.compact()
    before = files(tmp_path)
    log.append(rows(spark, [(7, "new"), (14, "new")]), 1)        # one group, so one bucket
    added = {f: n for f, n in files(tmp_path).items() if f not in before}
    assert sum(added.values()) < 0.02 * sum(before.values())
    dirty = log.compact()
    assert len(dirty) == 1
    made = {f for f in files(tmp_path) if f not in before and f not in added}
    assert made and all(f"_bucket={dirty[0]}/" in f for f in made)
    assert state(log)[7] == "new" and len(state(log)) == 20_000
    log.append(log.read(spark.createDataFrame([("g0",)], "g string")).withColumn("_deleted", F.lit(True)), 2)
    log.compact()
    left = state(log)
    assert left and not [k for k in left if k % 7 == 0]


def test_rows_without_keys_add_up(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path), SCHEMA, ["g"], buckets=4, sort_by=["k"])
    for b in range(3):
        log.append(rows(spark, [(1, "x"), (2, "y")]), b)
    assert log.read().count() == 6
    log.compact()
    assert log.read().count() == 6 and len(log.commits()) == 4
