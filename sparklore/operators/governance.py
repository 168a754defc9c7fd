"""Tenancy, settings, audit log and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklore.session import stored_table

#: Tenants that are broadcast at most.
BROADCAST_TENANTS = 500_000

# Settings every tenant starts with and their allowed ranges.
DEFAULTS = {
    "lint_ambiguous_ratio": 0.15,
    "lint_inferred_ratio": 0.40,
    "lint_hub_inferred_ratio": 0.20,
    "default_depth": "D1",
    "summary_max_chars": 200,
    "custom_rules": "",
}
RANGES = {
    "lint_ambiguous_ratio": (0.0, 1.0),
    "lint_inferred_ratio": (0.0, 1.0),
    "lint_hub_inferred_ratio": (0.0, 1.0),
    "summary_max_chars": (1, 2000),
}
LIST_FIELDS = ["entity_types", "relation_types"]
ENTITY_TYPES = ["org", "person", "product", "project", "location", "time", "concept"]

# Upper bounds in seconds of the latency histogram.
LATENCY_BUCKETS = [0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0]


def effective_settings(rows: DataFrame, settings: DataFrame | None) -> DataFrame:
    """``rows`` with every setting of their tenant, or its default.

    Settings hold one row per tenant; Spark broadcasts them only while they are below its
    own size threshold.
    """
    have = [] if settings is None else [c for c in settings.columns if c in DEFAULTS]
    out = rows if settings is None else rows.join(settings.select("tenant_id", *have), "tenant_id", "left")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in have else F.lit(v)
                            for k, v in DEFAULTS.items()})


def validate_overrides(overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, violations) of long-form override rows (tenant_id, field, value)."""
    number = F.expr("try_cast(value as double)")
    problem = F.when(~F.col("field").isin([*DEFAULTS, *LIST_FIELDS]), "unknown_field")
    for name, (low, high) in RANGES.items():
        mine = F.col("field") == name
        problem = problem.when(mine & number.isNull(), "not_a_number") \
                         .when(mine & ~number.between(low, high), "out_of_range")
    checked = overrides.withColumn("problem", problem)
    return checked.filter("problem is null").drop("problem"), checked.filter("problem is not null")


def newest_per_tenant(log: DataFrame, n: int = 50, order: str = "ts", tie: str = "seq") -> DataFrame:
    """Newest ``n`` rows of every tenant; each task keeps only its own best ``n`` before the shuffle."""
    w = Window.partitionBy("tenant_id").orderBy(F.desc(order), F.desc(tie))
    return log.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _tenant_list(tenants: DataFrame, max_rows: int) -> DataFrame:
    """The distinct tenants, written once and counted; broadcast up to ``max_rows``, so that the rows they choose do not meet by tenant."""
    listed = stored_table(tenants.select("tenant_id").distinct())
    return F.broadcast(listed) if listed.count() <= max_rows else listed


def only_active(rows: DataFrame, tenants: DataFrame, broadcast_rows: int = BROADCAST_TENANTS) -> DataFrame:
    """Rows of active tenants; the semi-join every read goes through."""
    return rows.join(_tenant_list(tenants.filter("status = 'active'"), broadcast_rows), "tenant_id", "left_semi")


def cross_tenant_leaks(links: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Links whose target exists, but only in another tenant."""
    elsewhere = links.join(owners.select(key, F.col("tenant_id").alias("owner_tenant")), key)
    mine = owners.select("tenant_id", key)
    return elsewhere.filter("owner_tenant <> tenant_id").join(mine, ["tenant_id", key], "left_anti")


def purge(rows: DataFrame, purged: DataFrame, broadcast_rows: int = BROADCAST_TENANTS) -> DataFrame:
    """Rows of all other tenants."""
    return rows.join(_tenant_list(purged, broadcast_rows), "tenant_id", "left_anti")


def purge_tables(root: str, names: list[str], tenants: DataFrame, purged: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Physically empties the partitions of purged tenants in all tables; (tenants with the new status, audit rows).

    ``root``/name are Parquet tables with one folder per tenant (``write_by_tenant``). ``purged``: tenant_id, the list of one
    administrative act. Each of their folders is overwritten by an empty file of the same columns, so no file of
    another tenant is read, moved or listed anew; a repeated purge does nothing more. audit: one row per tenant and table.
    """
    spark = tenants.sparkSession
    gone = [r["tenant_id"] for r in purged.select("tenant_id").distinct().collect()]
    audit = []
    for name in names:
        table = spark.read.parquet(f"{root}/{name}")
        counted = {r["tenant_id"]: r["count"] for r in table.filter(F.col("tenant_id").isin(gone)).groupBy("tenant_id").count().collect()}
        for tenant, n in sorted(counted.items()):
            table.drop("tenant_id").limit(0).write.mode("overwrite").parquet(f"{root}/{name}/tenant_id={tenant}")
            audit.append((tenant, "purge", name, n, float(now)))
    after = tenants.withColumn("status", F.when(F.col("tenant_id").isin(gone), "suspended").otherwise(F.col("status")))
    return after, spark.createDataFrame(audit, "tenant_id string, action string, target string, n_rows long, ts double")


def counters(events: DataFrame, labels: list[str], amount: str | None = None) -> DataFrame:
    value = F.sum(F.col(amount)) if amount else F.count(F.lit(1))
    return events.groupBy(*labels).agg(value.alias("total"))


def histogram(events: DataFrame, labels: list[str], value: str,
              buckets: list[float] | None = None) -> DataFrame:
    """Cumulative bucket counts in long form, with sum and count of each label set."""
    bounds = buckets or LATENCY_BUCKETS
    v = F.col(value)
    agg = events.groupBy(*labels).agg(
        *[F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)],
        F.count(F.lit(1)).alias("count"), F.sum(v).alias("sum"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("bucket_count"))
             for i, b in enumerate(bounds)] + [F.struct(F.lit("+Inf").alias("le"),
                                                        F.col("count").alias("bucket_count"))]
    return agg.select(*labels, F.explode(F.array(*cells)).alias("c"), "count", "sum").select(
        *labels, "c.le", "c.bucket_count", "count", "sum")


def hit_ratio(events: DataFrame, labels: list[str], hit) -> DataFrame:
    return events.groupBy(*labels).agg(
        F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("calls")).withColumn(
        "hit_ratio", F.try_divide(F.col("hits"), F.col("calls")))
