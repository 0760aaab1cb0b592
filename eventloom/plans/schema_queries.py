"""Queries of schemas, settings, ids and stored layouts, applied to the rows of the given tables, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import config, filters
from eventloom.functions import text as tx
from eventloom.functions.envelope import ENV_SQL
from eventloom.operators import governance, metrics, sampling
from eventloom.plans.event_queries import _UNIT, env, event_query, table
from eventloom.plans.registry import query
from eventloom.plans.storage import shared_path
from eventloom.sinks import tables
from eventloom.sources import schemas

# Literals and ids.

_UNITS = ("ms", "s", "m", "h", "d", "w", "")


@event_query("fn18_durations", "SELECT event_id, k * [1000000, 1000000000, 60000000000, 3600000000000, 86400000000000, NULL, NULL][event_id % 7 + 1] AS ns FROM env")
def durations(e: DataFrame) -> DataFrame:
    """Literals of all units, of one that there isn't and of none."""
    unit = F.get(F.array(*(F.lit(u) for u in _UNITS)), (F.col("event_id") % 7).cast("int"))
    return e.select("event_id", tx.duration_column(F.concat(F.col("k").cast("string"), unit)).alias("ns"))


def _framed(*parts: str) -> str:
    return "substr(sha256(" + " || ".join(f"octet_length(encode({p})) || ':' || {p}" for p in parts) + "), 1, 16)"


@event_query("fn21_callsite_ids", f"SELECT service, full_name, sev, {_framed('service', 'full_name', 'sev', chr(39) + 'bucket,event_type,region' + chr(39))} AS callsite_id, count(*) AS n FROM env GROUP BY service, full_name, sev")
def callsite_ids(e: DataFrame) -> DataFrame:
    """Ids of callsites: source, event, severity and label keys; hashed once a callsite, not once a row."""
    sites = e.groupBy("service", "full_name", "sev", F.array_join(F.array_sort(F.map_keys("labels")), ",").alias("keys")).agg(F.count("*").alias("n"))
    return sites.select("service", "full_name", "sev", tx.digest_id(F.col("service"), F.col("full_name"), F.col("sev"), F.col("keys")).alias("callsite_id"), "n")


# A registry made of parts: a brand is an event, a size a field of it. Some brands have no fields, some no prefix.

_KINDS, _CARDINALITIES, _CLASSES, _TIERS = ("LABEL", "ATTRIBUTE", "MEASUREMENT", "TRACE_ID"), ("LOW", "MEDIUM", "HIGH", "UNBOUNDED"), ("INTERNAL", "PII", "SECRET"), ("LOG", "AUDIT", "TRACE")
_PART_FIELDS = f"""WITH grouped AS (SELECT CASE WHEN p_brand LIKE '%3' THEN p_brand ELSE 'Obs' || p_brand END AS event, p_brand, p_size AS tag, min(p_partkey) AS pk FROM part GROUP BY ALL),
    fields AS (SELECT event, tag, CASE WHEN p_brand LIKE '%5' THEN NULL WHEN pk % 9 = 0 THEN 'payload' WHEN pk % 9 = 1 THEN 'trace_id' WHEN pk % 9 = 2 THEN 'CamelCase' ELSE 'field_' || tag END AS field,
    {list(_KINDS)}[pk % 4 + 1] AS kind, {list(_CARDINALITIES)}[pk // 4 % 4 + 1] AS cardinality, {list(_CLASSES)}[pk // 16 % 3 + 1] AS class, CASE WHEN pk % 2 = 0 THEN 'counter' END AS metric, CASE WHEN pk % 6 = 0 THEN 'long' ELSE 'string' END AS type, {list(_TIERS)}[pk // 3 % 3 + 1] AS tier FROM grouped) """


def _part_fields(spark: SparkSession, d: str) -> DataFrame:
    brand, pk = F.col("p_brand"), F.col("pk")
    grouped = table(spark, d, "part").groupBy("p_brand", F.col("p_size").alias("tag")).agg(F.min("p_partkey").alias("pk"))
    of = lambda by, xs: F.get(F.array(*(F.lit(x) for x in xs)), by.cast("int"))
    name = F.when(pk % 9 == 0, "payload").when(pk % 9 == 1, "trace_id").when(pk % 9 == 2, "CamelCase").otherwise(F.concat(F.lit("field_"), F.col("tag").cast("string")))
    return grouped.select(
        F.when(brand.endswith("3"), brand).otherwise(F.concat(F.lit("Obs"), brand)).alias("event"),
        "tag",
        F.when(~brand.endswith("5"), name).alias("field"),
        of(pk % 4, _KINDS).alias("kind"),
        of(F.floor(pk / 4) % 4, _CARDINALITIES).alias("cardinality"),
        of(F.floor(pk / 16) % 3, _CLASSES).alias("class"),
        F.when(pk % 2 == 0, "counter").alias("metric"),
        F.when(pk % 6 == 0, "long").otherwise("string").alias("type"),
        of(F.floor(pk / 3) % 3, _TIERS).alias("tier"),
    )


_RULES = {
    "L001": "kind = 'LABEL' AND cardinality IN ('HIGH', 'UNBOUNDED')",
    "L002": "kind = 'LABEL' AND class = 'PII'",
    "L003": "class = 'SECRET' AND tier <> 'TRACE'",
    "L004": "kind = 'MEASUREMENT' AND metric IS NULL",
    "L006": "tier = 'AUDIT' AND class <> 'INTERNAL'",
    "L007": "field = 'CamelCase'",
    "L012": "field = 'payload' AND kind <> 'TRACE_ID'",
    "L014": "kind = 'TRACE_ID' AND (field <> 'trace_id' OR type <> 'string')",
}


@query(
    "gv01_lint",
    _PART_FIELDS
    + " UNION ALL ".join(f"SELECT event, field, '{rule}' AS rule FROM fields WHERE field IS NOT NULL AND {broken}" for rule, broken in _RULES.items())
    + " UNION ALL SELECT DISTINCT event, NULL, 'L011' FROM fields WHERE NOT starts_with(event, 'Obs') UNION ALL SELECT event, NULL, 'L009' FROM fields GROUP BY event HAVING count(field) = 0",
)
def lint(spark: SparkSession, d: str) -> DataFrame:
    return governance.lint(_part_fields(spark, d))


@query(
    "fn20_schema_hashes",
    _PART_FIELDS
    + ", text AS (SELECT event, string_agg(coalesce(field, '') || ':' || kind || ':' || cardinality || ':' || class, ',' ORDER BY tag) AS declared, count(*) AS n_fields FROM fields GROUP BY event)"
    + f" SELECT event, n_fields, {_framed('event', 'declared')} AS schema_hash FROM text",
)
def schema_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Ids of schemas: the event and its declared fields in their order (an event's fields are one small group)."""
    entry = F.struct("tag", F.concat_ws(":", F.coalesce("field", F.lit("")), "kind", "cardinality", "class").alias("text"))
    declared = _part_fields(spark, d).groupBy("event").agg(F.array_sort(F.collect_list(entry)).alias("fields"))
    text = F.array_join(F.transform("fields", lambda x: x["text"]), ",")
    return declared.select("event", F.size("fields").cast("long").alias("n_fields"), tx.digest_id(F.col("event"), text).alias("schema_hash"))


@event_query(
    "sc10_schema_catalogue",
    """SELECT full_name, full_name <> 'shop.v1.ObsView' AS known, count(*) AS n, CAST(sum(CASE WHEN full_name = 'shop.v1.ObsError' AND tier <> 'AUDIT' THEN 1 ELSE 0 END) AS BIGINT) AS n_other_tier,
    CAST(sum(CASE WHEN full_name = 'shop.v1.ObsError' AND sev <> 'ERROR' THEN 1 ELSE 0 END) AS BIGINT) AS n_other_sev FROM env GROUP BY full_name""",
)
def catalogue(e: DataFrame) -> DataFrame:
    """Events against the catalogue's defaults; one schema is unknown and one declares another tier."""
    known = schemas.schema_table(e.sparkSession, schemas.SCHEMAS).where("full_name <> 'shop.v1.ObsView'")
    return governance.deviating(e, known.withColumn("tier", F.when(F.col("full_name") == "shop.v1.ObsError", "AUDIT").otherwise(F.col("tier"))))


@event_query("fl23_filter_labels", "SELECT a.event, a.label, a.label = 'region' AND a.event IN (SELECT full_name FROM env) AS is_label FROM (VALUES ('shop.v1.ObsClick', 'region'), ('shop.v1.ObsClick', 'latency_ms'), ('shop.v1.ObsView', 'nowhere'), ('shop.v1.ObsView', 'region'), ('shop.v1.ObsNone', 'region')) a(event, label)")
def filter_labels(e: DataFrame) -> DataFrame:
    """The labels that a filter reads, and whether the rows of the event have them."""
    wanted = filters.label_keys("info,shop.v1.ObsClick[region=1,latency_ms=2]=debug,shop.v1.ObsView[nowhere=x]=off,shop.v1.ObsView[region=3]=off,shop=warn,shop.v1.ObsNone[region=1]=off")
    return governance.filter_labels(governance.seen_labels(e), wanted)


# Settings.

_YAML = """
filter: ${FILTER:-info}
sampling:
  default_rate: ${RATE}
  per_event: {shop.v1.ObsPurchase: 0.5}
limits:
  max_payload_bytes: 9
"""


@event_query(
    "sc11_settings",
    f"SELECT event_id, CASE WHEN octet_length(encode(props)) > 9 THEN 'PAYLOAD' END AS broken FROM env WHERE sev_rank >= 2 AND (sev_rank >= 4 OR {_UNIT} < CASE WHEN full_name = 'shop.v1.ObsPurchase' THEN 0.5 ELSE 0.25 END)",
)
def settings(e: DataFrame) -> DataFrame:
    """A pipeline's settings, from YAML and the environment, decide what is kept of the events and which payloads are too long."""
    s = config.from_yaml(_YAML, {"RATE": "0.25", "OBS_FILTER": "debug", "OTHER_FILTER": "x"}, "obs")
    kept = e.where(filters.allowed(s.filter) & sampling.head_decision(s.sampling.default_rate, s.sampling.per_event))
    return kept.select("event_id", sampling.within_caps(F.col("props"), F.col("labels"), s.limits.max_payload_bytes, s.limits.max_label_value_bytes).alias("broken"))


# Metrics with bounds of their own.

_BOUNDS = {"shop.v1.ObsClick": [10.0, 100.0], "shop.v1.ObsError": [50.0, 75.0, 100.0, 250.0], "shop.v1.ObsPurchase": [25.0]}
_BOUND_ROWS = ", ".join(f"('{m}', {b})" for m, bs in _BOUNDS.items() for b in bs)


@event_query(
    "ag03_metric_bounds",
    f""", b(full_name, bound) AS (VALUES {_BOUND_ROWS}), series AS (SELECT full_name, region, count(value) AS n, round(sum(value), 4) AS total FROM env GROUP BY ALL),
    hit AS (SELECT e.full_name, e.region, b.bound, sum(CASE WHEN e.value <= b.bound THEN 1 ELSE 0 END)::BIGINT AS c FROM env e JOIN b ON b.full_name = e.full_name GROUP BY ALL),
    listed AS (SELECT full_name, region, string_agg(c, ',' ORDER BY bound) AS buckets FROM hit GROUP BY ALL)
    SELECT s.full_name, s.region, coalesce(l.buckets, '') AS buckets, n, total FROM series s LEFT JOIN listed l ON l.full_name = s.full_name AND l.region = s.region""",
)
def metric_bounds(e: DataFrame) -> DataFrame:
    """Each metric's histogram has its own bounds; metrics without a declaration have a count and a sum only."""
    declared = e.sparkSession.createDataFrame(list(_BOUNDS.items()), "metric string, bounds array<double>")
    found = metrics.metric_histograms(e.withColumn("region", F.col("labels")["region"]), ["full_name", "region"], "full_name", "value", declared)
    return found.select("full_name", "region", F.array_join(F.transform("buckets", lambda x: x.cast("string")), ",").alias("buckets"), "n", F.round("total", 4).alias("total"))


# Stored layouts.


@query("sk23_table_ddl", ENV_SQL + "SELECT service, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM env GROUP BY ALL")
def created_table(spark: SparkSession, d: str) -> DataFrame:
    """The events in a table made by its own DDL, read back from the folder that the DDL names."""
    rows = tables.with_partitions(env(spark, d)).select("event_id", "full_name", "ts_ns", "k", "service", "date")
    name, at = f"events_{uuid.uuid4().hex}", shared_path(spark, "created")
    spark.sql(tables.ddl(rows.schema, name, location=at))
    try:
        rows.hint("rebalance", "service", "date").write.insertInto(name)
        stored = spark.table(name).schema
    finally:
        spark.sql(f"DROP TABLE {name}")  # the folder of an external table stays
    found = spark.read.schema(stored).parquet(at)
    return found.groupBy("service", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("sk24_schema_json", ENV_SQL + "SELECT tier, count(*) AS n, count(DISTINCT trace_id) AS n_traces, CAST(sum(k) AS BIGINT) AS total FROM env GROUP BY tier")
def read_by_schema(spark: SparkSession, d: str) -> DataFrame:
    """The stored events read by the schema that was kept beside them as JSON."""
    at = shared_path(spark, "kept")
    rows = tables.with_partitions(env(spark, d))
    tables.write(rows, at)
    found = tables.read_as(spark, at, tables.schema_json(rows.schema))
    return found.groupBy("tier").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("n_traces"), F.sum("k").alias("total"))


@query("gv07_migrations", ENV_SQL + "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, count(CASE WHEN ts >= TIMESTAMP '2024-01-15' THEN k END) AS n_k FROM env GROUP BY ALL")
def migrated(spark: SparkSession, d: str) -> DataFrame:
    """A table that gained a column: rows stored before it have nulls there, later ones their values."""
    at, rows = shared_path(spark, "migrated"), tables.with_partitions(env(spark, d))
    tables.write(rows.where("date < '2024-01-15'").drop("k"), at)
    tables.write(rows.where("date >= '2024-01-15'"), at)
    return tables.read(spark, at).groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("n"), F.count("k").alias("n_k"))
