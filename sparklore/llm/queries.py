"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklore.llm import (bpe, centroids, classifier, licenses, lines, mixing, quality, repeats, search, secrets, simhash,
                           whitening)
from sparklore.llm.common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def tokenizer() -> str:
    """The vocabulary file of the queries on tokens; the operators take any path."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_bpe_round_trip")
def op1(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer(), keep=["doc_id"])


@query("op2_mix_to_weights")
def op2(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


@query("op3_quality_rules")
def op3(spark, sf_dir):
    measured = stored(quality.measure(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"]))
    cutoffs = stored(quality.fit_cutoffs(measured, table(spark, sf_dir, "labels")))
    return quality.judge(measured, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.concat_ws(",", "broken_rules").alias("broken_rules"))


@query("op7_exact_top_k", """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS DOUBLE)) AS w
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op7(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", search.weights_of(F.col("embedding")).alias("w"))
    return search.top_k(vectors.filter("vec_id % 100 = 0"), vectors)


@query("op8_line_dedup", r"""
WITH plain AS (
    SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
           regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') AS x
    FROM pages),
broken AS (
    SELECT page_id, host, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x,
        '(?i)</?(?:p|div|li|ul|ol|h[1-6]|br|nav|article|section|header|footer|title|table|tr|td|th|body|head|html|main|aside|pre|blockquote)\b[^>]*>',
        chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t\r]*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS x
    FROM plain),
lined AS (
    SELECT *, row_number() OVER () AS row_no, string_split(x, chr(10)) AS ls FROM broken),
lines AS (
    SELECT DISTINCT row_no, host, unnest(ls) AS line FROM lined WHERE host IS NOT NULL),
totals AS (SELECT host, count(*) AS pages FROM lined GROUP BY host),
bad AS (
    SELECT l.host, list(l.line) AS bl FROM (
        SELECT host, line, count(*) AS n FROM lines WHERE trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''
        GROUP BY ALL) l
    JOIN totals t USING (host) WHERE t.pages >= 10 AND l.n > t.pages * 0.1 AND l.n > 1 GROUP BY l.host),
done AS (
    SELECT page_id, d.host, ls, list_filter(ls, lambda x: bl IS NULL OR NOT list_contains(bl, x)) AS kept
    FROM lined d LEFT JOIN bad USING (host))
SELECT page_id, host, len(list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '')) AS n_lines,
       len(ls) - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text
FROM done
""")
def op8(spark, sf_dir):
    # Read twice, so pages are turned into lines once.
    pages = stored(table(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"),
                                                        lines.html_lines(F.col("html")).alias("text")))
    return lines.drop_boilerplate(pages, keep=["page_id", "host"]).select("page_id", "host", "n_lines", "n_dropped", "text")


@query("op9_token_counts")
def op9(spark, sf_dir):
    counted = bpe.count_tokens(table(spark, sf_dir, "documents"), tokenizer())
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op10_license_scan")
def op10(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.transform("phrases", lambda p: p["start"])
    labels = [F.transform(c, lambda p: p["label"]) for c in ("phrases", "templates")]

    def joined(names):
        return F.array_join(F.array_sort(F.array_distinct(names)), ",")

    return found.select("doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
                        F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
                        joined(labels[0]).alias("base_labels"), joined(F.concat(*labels)).alias("labels"), "score")


@query("op6_simhash_components")
def op6(spark, sf_dir):
    return simhash.component_ids(table(spark, sf_dir, "documents"))


@query("op5_repeat_removal")
def op5(spark, sf_dir):
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    # text: the remaining bytes; a character that is cut in two shows as the replacement character.
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


@query("op4_secret_scan")
def op4(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "pos", "run", F.concat(F.substring("value", 1, 4), F.lit("...")).alias("starts"),
                        F.sha2("value", 256).alias("value_sha256"), "name", "path", "length", "changes", "surprise", "known",
                        "score", "is_secret")


@query("op11_quality_classifier")
def op11(spark, sf_dir):
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _rounds_sql(rounds: int, k: int) -> str:
    """k-means on integers as chained CTEs: a<r> places every vector, m<r> moves the centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS (SELECT row_no, min(list_sum(list_transform(list_zip(v.x, m.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * {k} + m.c) AS best
    FROM v, m{r} m GROUP BY row_no)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (SELECT c, d, sum(x)::BIGINT AS s, count(*) AS n
    FROM (SELECT best % {k} AS c, unnest(v.x) AS x, unnest(range(1, len(v.x) + 1)) AS d FROM a{r} JOIN v USING (row_no)) GROUP BY c, d),
m{r + 1} AS (SELECT m.c, coalesce(g.x, m.x) AS x FROM m{r} m
    LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) / n)::BIGINT ORDER BY d) AS x FROM s{r} GROUP BY c) g USING (c))""")
    return ",".join(steps)


@query("op12_centroid_clustering", f"""
WITH v AS (
    SELECT row_number() OVER () AS row_no, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
m0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || vec_id), x) - 1 AS INTEGER) AS c, x FROM v QUALIFY c < 16),{_rounds_sql(3, 16)},
placed AS (SELECT row_no, (best % 16)::INTEGER AS cluster, best // 16 AS distance FROM a3)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(m3.x, ',')) AS centroid_sha256
FROM placed JOIN v USING (row_no) JOIN m3 ON m3.c = cluster
""")
def op12(spark, sf_dir):
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))
