"""Corpora of many small files."""

import glob

from pyspark.sql import functions as F

from sparklore.sources import corpus


def test_many_folders_are_written_and_listed_by_few_tasks(spark, tmp_path):
    root, n = f"{tmp_path}/corpus", 100
    docs = spark.range(n).select(F.lit("a").alias("tenant"), F.concat(F.lit("d"), "id").alias("doc"), F.lit("text").alias("content"))
    docs.repartition(corpus.writers(spark), "tenant", "doc").write.options(**corpus.SMALL_FILES).partitionBy("tenant", "doc").text(root)
    assert len(glob.glob(f"{root}/tenant=a/*/*.txt")) == n
    assert not glob.glob(f"{root}/tenant=a/*/.*.crc")

    sc = spark.sparkContext
    sc.setJobGroup("listing", "folders are listed")
    read = corpus.read_text_corpus(spark, root)
    sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    tasks = [tracker.getStageInfo(s).numTasks for s in stages]
    assert tasks and max(tasks) <= corpus.writers(spark) < n
    assert read.count() == n
