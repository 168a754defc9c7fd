"""The stages of the pipeline, and the registered queries on the small tables."""

import random
import string

import pytest

import corpus_pipeline as cp
from sparklore.llm.queries import QUERIES, SQL
from tests.oracle import normal, oracle

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark, tmp_path_factory):
    rng = random.Random(11)
    folder = str(tmp_path_factory.mktemp("tables"))
    rows = []
    for i in range(60):
        body = " ".join("".join(rng.choice(string.ascii_lowercase) for _ in range(rng.randint(3, 8))) for _ in range(60))
        rows.append([i, f"Site menu\n{body}", "en", f"s{i % 3}"])
    rows += [[60, rows[5][1], "en", "s2"], [61, rows[5][1].upper(), "en", "s2"], [62, "too short", "en", "s1"], [63, None, None, None], [64, "", "fr", "s0"]]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(30)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, documents):
    docs = spark.read.parquet(f"{documents}/documents.parquet")
    columns = docs.columns
    assert 4 <= len(cp.STAGES) <= 5
    kept = cp.quality_rules(spark, docs, documents)
    assert kept.columns == columns and {r["doc_id"] for r in kept.collect()} == {*range(62)}
    cut = cp.line_dedup(spark, kept, documents)
    assert cut.columns == columns
    assert all("Site menu" not in r["text"] and r["n_chars"] == len(r["text"]) for r in cut.filter("doc_id < 61").collect())
    one = cp.near_dedup(spark, cut, documents)
    assert one.columns == columns and sorted(r["doc_id"] for r in one.collect()) == [*range(60)]  # 61 has the menu line in capitals and is a copy of 5 otherwise
    mixed = cp.mix_sources(spark, one, documents)
    assert mixed.columns == columns
    out = cp.tokenize(spark, mixed, documents).collect()
    assert len(out) == mixed.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert sorted(r["doc_id"] for r in cp.run(spark, documents).collect()) == sorted(r["doc_id"] for r in out)


def test_no_documents(spark, documents, tmp_path):
    spark.read.parquet(f"{documents}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{documents}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    out = QUERIES[name](spark, SF)
    columns, rows = normal(out.columns, [tuple(r) for r in out.collect()])
    assert rows
    if name in SQL:
        cur = oracle(SF).execute(SQL[name])
        assert (columns, rows) == normal([d[0] for d in cur.description], cur.fetchall())
