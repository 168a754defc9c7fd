"""Knowledge tables over the driver tables, as DataFrames."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklore.functions import text as tx
from sparklore.operators import graph
from sparklore.plans.fixture_sql import NOW
from sparklore.session import ensure_checkpoint_dir
from sparklore.sources.adjacency import Adjacency
from sparklore.sources.search_index import SearchIndex
from sparklore.sources.vector_index import VectorIndex

__all__ = ["Kb", "NOW"]

SETTINGS_SCHEMA = ("tenant_id string, lint_ambiguous_ratio double, "
                   "lint_hub_inferred_ratio double, summary_max_chars int")


TEXT_TABLES = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on text that arrives in fewer input splits than there are cores.

    A large table has far more splits than cores and is left as it is, without a shuffle.
    """
    sc = df.sparkSession.sparkContext
    paths = df.inputFiles()
    if len(paths) >= sc.defaultParallelism:
        return df
    return df.repartition(sc.defaultParallelism) if df.rdd.getNumPartitions() < sc.defaultParallelism else df


def _tenant(key):
    return F.concat(F.lit("t"), (key % 4).cast("string"))


def epoch_seconds(ts):
    """Whole seconds since 1970 of a zone-less timestamp, whatever the session time zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


class Kb:
    """Lazy knowledge tables for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df

    @cached_property
    def documents(self) -> DataFrame:
        d = F.col("doc_id")
        return self.raw("documents").select(
            _tenant(d).alias("tenant_id"), tx.cat("doc_", d).alias("document_id"), "doc_id",
            tx.cat("source", F.lit("/"), d, literal_first=False).alias("title"),
            F.col("source").alias("source_uri"), F.lit("queryable_full").alias("status"),
            tx.cat("D", d % 3).alias("depth"),
            (F.floor(F.col("n_chars") / 1800) + 1).alias("page_count"),
            (F.lit(1704067200) + d * 60).cast("double").alias("created_at"),
            F.col("text").alias("content"), "n_chars")

    @cached_property
    def spans(self) -> DataFrame:
        lines = self.raw("documents").select(
            "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "content"))
        d, i = F.col("doc_id"), (F.col("p") + 1)
        return lines.select(
            _tenant(d).alias("tenant_id"), tx.cat("doc_", d).alias("document_id"),
            tx.cat("ch_", d).alias("chunk_id"), tx.cat("sp_", d, F.lit("_"), i).alias("span_id"),
            i.cast("long").alias("span_no"), "content", F.lit("text").alias("span_type"),
            (F.floor(F.col("p") / 10) + 1).alias("page"), "doc_id")

    @cached_property
    def chunks(self) -> DataFrame:
        d = F.col("doc_id")
        return self.raw("documents").select(
            _tenant(d).alias("tenant_id"), tx.cat("doc_", d).alias("document_id"),
            tx.cat("ch_", d).alias("chunk_id"), F.col("text").alias("content"),
            F.col("source").alias("section_path"), tx.content_hash("text", F.lit("v1")).alias("content_hash"),
            tx.summary("text", 200).alias("summary"),
            F.when(d % 4 == 0, "core").when(d % 4 == 1, "supporting")
             .when(d % 4 == 2, "peripheral").alias("tier"),
            F.lit(1).cast("long").alias("page_start"), "doc_id")

    @cached_property
    def entities(self) -> DataFrame:
        no_alias = F.array().cast("array<string>")
        four = self.spark.range(4).select(F.col("id").alias("t"))

        def shape(df, tenant_key, entity_id, name, kind, doc_no, aliases=no_alias):
            return df.select(_tenant(tenant_key).alias("tenant_id"), entity_id.alias("entity_id"),
                             F.col(name).alias("name"), F.lit(kind).alias("type"),
                             aliases.alias("aliases"), doc_no.alias("doc_no"))

        t, p, c = F.col("t"), F.col("p_partkey"), F.col("c_custkey")
        s, n = F.col("s_suppkey"), F.col("n_nationkey")
        parts = shape(self.raw("part"), p, tx.cat("part_", p), "p_name", "product", p,
                      F.array(F.concat_ws(" ", "p_name", "p_brand")))
        suppliers = shape(self.raw("supplier").join(F.broadcast(four)), t,
                          tx.cat("supp_", t, F.lit("_"), s), "s_name", "org", s * 4 + t)
        nations = shape(self.raw("nation").join(F.broadcast(four)), t,
                        tx.cat("nat_", t, F.lit("_"), n), "n_name", "location", n * 4 + t)
        customers = shape(self.raw("customer"), c, tx.cat("cust_", c), "c_name", "person", c)
        vectors = self.raw("embeddings").select(F.col("vec_id").alias("doc_no"), "embedding",
                                                F.lit("product").alias("type"))
        return (parts.unionByName(suppliers).unionByName(nations).unionByName(customers)
                .join(vectors, ["type", "doc_no"], "left")
                .select("tenant_id", "entity_id", "name", "type", "aliases",
                        tx.cat("doc_", F.col("doc_no")).alias("document_id"),
                        tx.cat("sp_", F.col("doc_no"), F.lit("_1")).alias("mention_span_id"), "embedding"))

    @cached_property
    def _lines(self) -> DataFrame:
        li = self.raw("lineitem")
        ship = epoch_seconds(F.col("l_shipdate"))
        return li.withColumns({
            "ship": ship.cast("double"),
            "key": F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                               F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                               ship.cast("string"), F.col("l_quantity").cast("string")),
            "span_id": tx.cat("sp_", F.col("l_partkey"), F.lit("_"), F.col("l_linenumber"))})

    @cached_property
    def sightings(self) -> DataFrame:
        p, s, c = F.col("l_partkey"), F.col("l_suppkey"), F.col("c_custkey")
        supply = self._lines.select(
            _tenant(p).alias("tenant_id"), tx.cat("supp_", p % 4, F.lit("_"), s).alias("source_entity"),
            F.when(F.col("l_linestatus") == "O", "owns").otherwise("develops").alias("relation_type"),
            tx.cat("part_", p).alias("target_entity"), "span_id", F.col("key").alias("seq"),
            F.col("ship").alias("seen_at"))
        home = self.raw("customer").filter("c_acctbal >= 0").select(
            _tenant(c).alias("tenant_id"), tx.cat("cust_", c).alias("source_entity"),
            F.lit("belongs_to").alias("relation_type"),
            tx.cat("nat_", c % 4, F.lit("_"), F.col("c_nationkey")).alias("target_entity"),
            tx.cat("sp_", c, F.lit("_1")).alias("span_id"), tx.cat("c", c).alias("seq"),
            F.lit(0.0).alias("seen_at"))
        return supply.unionByName(home)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.merge_sightings(self.sightings).select(
            "relation_id", "tenant_id", "source_entity", "relation_type", "target_entity",
            "source_count", "confidence")

    @cached_property
    def edge_spans(self) -> DataFrame:
        return graph.sighting_spans(self.sightings)

    @cached_property
    def facts(self) -> DataFrame:
        p, s, q = F.col("l_partkey"), F.col("l_suppkey"), F.col("q")
        base = self._lines.withColumns({
            "k": F.sha2("key", 256), "q": F.col("l_quantity").cast("long") % 10,
            "predicate": F.concat(F.when(F.col("l_linestatus") == "O", "depends_on_").otherwise("status_"),
                                  F.year("l_shipdate").cast("string"))})
        inferred_s = q < F.when(s % 10 == 0, 6).otherwise(1)

        def family(suffix, document_id, subject, provenance, inferred):
            return base.select(
                _tenant(p).alias("tenant_id"), F.concat("k", F.lit(suffix)).alias("fact_id"),
                document_id.alias("document_id"), subject.alias("subject_entity"), "predicate",
                F.col("l_returnflag").alias("object_value"), provenance.alias("provenance"),
                F.col("l_linenumber").cast("long").alias("source_count"),
                F.col("ship").alias("created_at"), F.col("ship").alias("last_confirmed"),
                (F.col("l_tax") > 0.07).alias("stale"),
                F.when(~(inferred & (F.col("l_discount") > 0.05)), F.col("span_id")).alias("span_id"))

        return family("p", tx.cat("doc_", p), tx.cat("part_", p),
                      F.when(q < 2, "inferred").when(q < 4, "ambiguous").otherwise("extracted"), q < 2
                      ).unionByName(
               family("s", tx.cat("doc_", s * 4 + p % 4), tx.cat("supp_", p % 4, F.lit("_"), s),
                      F.when(inferred_s, "inferred").when(q >= 8, "ambiguous").otherwise("extracted"),
                      inferred_s))

    @cached_property
    def concepts(self) -> DataFrame:
        return (self.raw("benchmark")
                .select(_tenant(F.col("item_id")).alias("tenant_id"),
                        F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name"))
                .distinct()
                .select("tenant_id", tx.cat("con_", F.col("tenant_id"), F.lit("_"), F.col("name")).alias("entity_id"),
                        "name", F.lit("concept").alias("type")))

    @cached_property
    def named(self) -> DataFrame:
        """Everything with a name that text may mention: all entities, and concepts of every length."""
        return self.entities.select("tenant_id", "entity_id", "name", "type").unionByName(self.concepts)

    @cached_property
    def questions(self) -> DataFrame:
        i = F.col("item_id")
        bucket = F.element_at(F.array(*[F.lit(b) for b in
                              ("detail", "table", "multi_doc", "long_doc", "summary")]),
                              (i % 5 + 1).cast("int"))
        return (self.raw("benchmark")
                .select("item_id", F.posexplode(tx.sentences("text")).alias("p", "raw"))
                .select(_tenant(i).alias("tenant_id"),
                        tx.cat("q_", i, F.lit("_"), F.col("p") + 1).alias("qid"), "item_id",
                        bucket.alias("bucket"), tx.strip("raw").alias("question"))
                .filter("question <> ''"))

    @cached_property
    def gold(self) -> DataFrame:
        said = self.spans.select("tenant_id", "span_id",
                                 F.explode(tx.sentences("content")).alias("raw")) \
            .select("tenant_id", "span_id", tx.strip("raw").alias("question"))
        return said.join(self.questions, ["tenant_id", "question"]).select("qid", "span_id").distinct()

    @cached_property
    def query_vectors(self) -> DataFrame:
        return (self.raw("embeddings").select("label", F.posexplode("embedding").alias("j", "x"))
                .groupBy("label", "j").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
                .groupBy(F.col("label").cast("long").alias("label"))
                .agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "m"))),
                                 lambda s: s["m"]).alias("vector")))

    @cached_property
    def turns(self) -> DataFrame:
        c = F.col("conv_id")
        return self.raw("conversations").select(
            _tenant(c).alias("tenant_id"), tx.cat("u", c % 50).alias("user_id"),
            tx.cat("s", c).alias("session_id"), "conv_id", "turn", "role", "text",
            (F.lit(1704067200) + c * 86400 + F.col("turn") * 60).cast("long").alias("ts"))

    @cached_property
    def answers(self) -> DataFrame:
        c, t, x = F.col("conv_id"), F.col("turn"), F.col("text")
        cited = F.concat(F.substring(x, F.lit(1), F.length(x) - 1),
                         tx.cat(" [doc_", c, F.lit(":sp_"), c, F.lit("_"),
                                F.when((c + t) % 7 == 0, 99999).otherwise(1), F.lit("].")))
        return self.turns.filter("role = 'assistant'").select(
            "tenant_id", tx.cat("a_", c, F.lit("_"), t).alias("answer_id"), "conv_id", "turn",
            F.when(((c + t) % 5 == 0) | ~x.endswith("."), x).otherwise(cited).alias("answer"))

    @cached_property
    def observations(self) -> DataFrame:
        user = F.col("role") == "user"
        return self.turns.filter(F.col("role").isin("user", "assistant")).select(
            "tenant_id", "user_id", "session_id",
            tx.cat("ob_", F.col("conv_id"), F.lit("_"), F.col("turn")).alias("obs_id"),
            F.when(user, "episodic").otherwise("semantic").alias("tier"),
            F.col("text").alias("content"), F.when(user, 0.6).otherwise(0.8).alias("confidence"),
            F.col("ts").alias("created_at"))

    @cached_property
    def audit(self) -> DataFrame:
        micros = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col("ts"))
        return self.raw("events").select(
            _tenant(F.col("user_id")).alias("tenant_id"), tx.cat("u", F.col("user_id")).alias("user_id"),
            F.col("event_type").alias("action"), F.col("props").alias("target"),
            (micros / 1000000.0).alias("ts"), F.col("event_id").alias("seq"), "value")

    @cached_property
    def manifest(self) -> DataFrame:
        c = self.chunks.join(self.raw("labels"), "doc_id")
        return c.select(
            "tenant_id", "document_id", "chunk_id",
            F.when(F.col("quality") == 1, F.col("content_hash"))
             .otherwise(F.sha2(F.concat(F.lit("old"), "content_hash"), 256)).alias("content_hash"),
            tx.cat("ft_", F.col("doc_id")).alias("fact_id"), tx.cat("part_", F.col("doc_id")).alias("entity_id"),
            tx.cat("wk_", F.col("doc_id")).alias("wiki_node_id"))

    @cached_property
    def settings(self) -> DataFrame:
        return self.spark.createDataFrame(
            [("t0", None, None, None), ("t1", 0.25, None, 120), ("t2", None, 0.5, 80)], SETTINGS_SCHEMA)

    @cached_property
    def degrees(self) -> DataFrame:
        return graph.degrees(self.entities, self.edges)

    @cached_property
    def new_entities(self) -> DataFrame:
        k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
        blurred = F.zip_with("v", F.reverse("v"), lambda x, y: x + 0.4 * y)
        vectors = self.raw("embeddings").select(
            F.col("vec_id").alias("p_partkey"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
        return self.raw("part").join(vectors, "p_partkey", "left").select(
            _tenant(k).alias("tenant_id"), tx.cat("new_", k).alias("entity_id"), "p_size",
            F.lit("product").alias("type"),
            F.when(size <= 12, F.upper(name)).when(size <= 25, F.concat_ws(" ", name, "p_brand"))
             .when(size <= 38, F.concat(name, F.lit("s")))
             .otherwise(F.concat(name, F.lit(" of "), "p_type")).alias("name"),
            blurred.alias("embedding"))

    @cached_property
    def merge_verdicts(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.raw("part").select(
            _tenant(k).alias("tenant_id"), tx.cat("new_", k).alias("entity_id"),
            tx.cat("part_", k).alias("canonical_id"), (F.col("p_size") % 2 == 1).alias("merge"))

    @cached_property
    def question_vectors(self) -> DataFrame:
        v = self.raw("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
        return self.questions.join(v, "item_id", "left")

    @cached_property
    def spans_with_vectors(self) -> DataFrame:
        v = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding",
                                          F.lit(1).cast("long").alias("span_no"))
        return self.spans.join(v, ["doc_id", "span_no"], "left")

    def _stored_at(self, kind: str, *tables: str) -> str:
        """The folder of something derived from tables, named by their files: changed data has a folder of its own."""
        files = None
        for name in tables:
            meta = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").select(
                "_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
            files = meta if files is None else files.union(meta)
        number = files.agg(F.sum(F.xxhash64("*").cast("decimal(20,0)")).alias("n")).first()["n"]
        return f"{ensure_checkpoint_dir(self.spark).rstrip('/')}/{kind}-{number}"

    @cached_property
    def search_index(self) -> SearchIndex:
        """The stored index of all spans: written by the first query that asks for it, read by all others."""
        index = SearchIndex(self.spark, self._stored_at("search-index", "documents"))
        if not index.exists():
            index.extend(self.spans, 0)
        return index

    @cached_property
    def vector_index(self) -> VectorIndex:
        index = VectorIndex(self.spark, self._stored_at("vector-index", "documents", "embeddings"))
        if not index.exists():
            index.extend(self.spans_with_vectors, "span_id", "embedding", 0)
        return index

    @cached_property
    def adjacency(self) -> Adjacency:
        stored = Adjacency(self.spark, self._stored_at("adjacency", "lineitem", "customer"))
        if not stored.log.exists():
            stored.extend(self.edges, 0)
        return stored

    @cached_property
    def model_scores(self) -> DataFrame:
        """Outside scores of (question, span) pairs: by text length, for the head of each document."""
        head = self.spans.filter("span_no <= 5").select(
            "tenant_id", "span_id", ((F.length("content") % 10) / 10.0).alias("model_score"))
        return head
