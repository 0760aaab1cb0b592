"""The envelope: one row per event, and how driver tables become envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities and tiers in rising order of their numbers, from 1.
SEVERITIES = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
TIERS = ("LOG", "METRIC", "TRACE", "AUDIT")
#: Kinds of fields, classes of their values, kinds of metrics.
KINDS = ("LABEL", "ATTRIBUTE", "MEASUREMENT", "TRACE_ID", "SPAN_ID", "PARENT_SPAN_ID")
CLASSES = ("INTERNAL", "PII", "SECRET")
METRICS = ("COUNTER", "GAUGE", "HISTOGRAM")
#: The OTLP number of each severity.
OTLP_NUMBERS = (1, 5, 9, 13, 17, 21)


def severity_name(text: Column) -> Column:
    """The severity that a word names in any case, null for other words."""
    word = F.regexp_replace(F.lower(F.trim(text)), "^severity_", "")
    word = F.when(word == "warning", F.lit("warn")).when(word == "err", F.lit("error")).otherwise(word)
    return F.when(word.isin([s.lower() for s in SEVERITIES]), F.upper(word))


def sev_rank(sev: Column) -> Column:
    """1 for TRACE to 6 for FATAL, null for other names."""
    return F.nullif(F.array_position(F.array(*(F.lit(s) for s in SEVERITIES)), sev), F.lit(0).cast("long")).cast("int")


def otlp_severity(rank: Column) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in OTLP_NUMBERS)), rank - 1), F.lit(0))


def tier_name(text: Column) -> Column:
    """The tier that a word names in any case, with or without ``tier_``; else null."""
    word = F.regexp_replace(F.upper(F.trim(text)), "^TIER_", "")
    return F.when(word.isin(list(TIERS)), word)


def nanos(ts: Column) -> Column:
    """Nanoseconds since 1970 of a TIMESTAMP_NTZ, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * 1000


def from_events(events: DataFrame) -> DataFrame:
    """``events`` as envelopes, with user_id, value and props as typed payload columns."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("long")
    sev = (
        F.when(kind == "error", F.when(F.col("value") >= 100, "FATAL").otherwise("ERROR"))
        .when(kind == "signup", "WARN").when(kind == "purchase", "INFO").when(kind == "click", "DEBUG").otherwise("TRACE")
    )
    tier = F.when(kind == "purchase", "AUDIT").when(kind == "click", "METRIC").when(kind == "view", "TRACE").otherwise("LOG")
    day = F.to_date("ts").cast("string")
    labels = F.create_map(
        F.lit("event_type"), kind, F.lit("region"), (F.col("user_id") % 5).cast("string"), F.lit("bucket"), F.floor(k / 10).cast("string")
    )
    return events.select(
        "event_id",
        "user_id",
        F.concat(F.lit("shop.v1.Obs"), F.initcap("event_type")).alias("full_name"),
        sev.alias("sev"),
        sev_rank(sev).alias("sev_rank"),
        tier.alias("tier"),
        nanos(F.col("ts")).alias("ts_ns"),
        F.md5(F.concat_ws("|", F.col("user_id").cast("string"), day)).alias("trace_id"),
        F.substring(F.md5(F.col("event_id").cast("string")), 1, 16).alias("span_id"),
        F.element_at(F.array(F.lit("api"), F.lit("web"), F.lit("batch")), (F.col("user_id") % 3 + 1).cast("int")).alias("service"),
        labels.alias("labels"),
        F.lit("HEAD_RATE").alias("sampling_reason"),
        "value",
        "props",
        k.alias("k"),
    )


#: The same rows as DuckDB SQL, as the first part of a WITH clause; labels as three columns.
ENV_SQL = """WITH env0 AS (
  SELECT event_id, user_id, 'shop.v1.Obs' || upper(event_type[1]) || event_type[2:] AS full_name,
    CASE event_type WHEN 'error' THEN CASE WHEN value >= 100 THEN 'FATAL' ELSE 'ERROR' END WHEN 'signup' THEN 'WARN'
      WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS sev,
    CASE event_type WHEN 'purchase' THEN 'AUDIT' WHEN 'click' THEN 'METRIC' WHEN 'view' THEN 'TRACE' ELSE 'LOG' END AS tier,
    epoch_us(ts) * 1000 AS ts_ns, md5(user_id || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS trace_id,
    substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS span_id, ['api', 'web', 'batch'][user_id % 3 + 1] AS service,
    event_type, CAST(user_id % 5 AS VARCHAR) AS region, value, props, ts,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) // 10 AS VARCHAR) AS bucket
  FROM events
), env AS (
  SELECT *, CASE sev WHEN 'TRACE' THEN 1 WHEN 'DEBUG' THEN 2 WHEN 'INFO' THEN 3 WHEN 'WARN' THEN 4 WHEN 'ERROR' THEN 5 ELSE 6 END AS sev_rank,
    'bucket=' || bucket || ',event_type=' || event_type || ',region=' || region AS labels_text
  FROM env0
)
"""


def labels_text(labels: Column, between: str = ",") -> Column:
    """Labels as ``k=v`` sorted by key: the canonical text of a series."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), between)
