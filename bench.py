"""Headline queries on one machine: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sparklore.plans import all_queries
from sparklore.plans.fixtures import Kb
from sparklore.session import local_session

HEADLINE = [
    "txt01_redact", "txt06_spans", "inc02_changed_chunks", "fct01_contradiction_groups", "fct08_resolve_contradiction",
    "grf03_relation_upsert", "grf05_neighborhood_nodes", "mnt01_lint_audit", "mnt06_unlinked_mentions",
    "ent08_resolve", "ret01_vector_top_k", "ret03_text_top_k", "ret04_trigram_top_k", "ret15_hybrid_search",
    "evl05_answer_verdicts", "wik03_page_sources", "gov06_histogram",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session("bench", cpus=cpus, shuffle_partitions=cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    known, seconds = all_queries(), {}
    start = time.time()
    Kb(spark, sf_dir).search_index      # stored once; the queries on text only read it
    seconds["search_index_build"] = round(time.time() - start, 3)
    for name in HEADLINE:
        start = time.time()
        known[name].run(Kb(spark, sf_dir)).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
