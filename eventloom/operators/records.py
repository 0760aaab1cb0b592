"""Projections of envelopes to log records, JSON, text lines and bridge events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.envelope import otlp_severity
from eventloom.functions.text import quoted_fields, redact_map, rfc3339, whole


def log_record(envelopes: DataFrame) -> DataFrame:
    """Log records: severity number and text, and attributes from labels and the envelope, whose own keys win."""
    own = {"event.name": "full_name", "obs.schema_hash": "schema_hash", "obs.parent_span_id": "parent_span_id", "obs.callsite_id": "callsite_id", "obs.sampling_reason": "sampling_reason"}
    pairs = [x for k, c in own.items() if c in envelopes.columns for x in (F.lit(k), F.col(c).cast("string"))]
    shown = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != "") & ((k != "obs.callsite_id") | (v != "0")))
    labels = F.map_filter("labels", lambda k, v: ~F.map_contains_key(shown, k))
    return envelopes.withColumns({"severity_number": otlp_severity(F.col("sev_rank")), "severity_text": F.col("sev"), "attributes": F.map_concat(labels, shown)})


def metric_points(envelopes: DataFrame, measures: dict[str, str]) -> DataFrame:
    """(full_name, metric, value, ..): a point per measured column; events without one count 1."""
    points = [F.when(F.col(c).isNotNull(), F.struct(F.lit(metric).alias("metric"), F.col(c).cast("double").alias("value"))) for c, metric in measures.items()]
    some = F.array_compact(F.array(*points))
    fallback = F.array(F.struct(F.concat("full_name", F.lit(".count")).alias("metric"), F.lit(1.0).alias("value")))
    return envelopes.select("*", F.explode(F.when(F.size(some) > 0, some).otherwise(fallback)).alias("p")).select(*envelopes.columns, "p.metric", F.col("p.value").alias("point"))


def compact_line() -> Column:
    """``time LEVEL leaf{k=v ..}: full name: trace_id=.. span_id=..``."""
    fields = quoted_fields(F.col("labels"))
    leaf = F.regexp_extract("full_name", r"([^.]*)$", 1)
    dash = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "-").otherwise(F.col(c))
    ids = (F.coalesce(F.col("trace_id"), F.lit("")) != "") | (F.coalesce(F.col("span_id"), F.lit("")) != "")
    return F.concat(
        rfc3339(F.col("ts_ns")), F.lit(" "), F.lpad("sev", 5, " "), F.lit(" "),
        F.when(fields == "", "").otherwise(F.concat(leaf, F.lit("{"), fields, F.lit("}: "))), F.col("full_name"),
        F.when(ids, F.concat(F.lit(": trace_id="), dash("trace_id"), F.lit(" span_id="), dash("span_id"))).otherwise(""),
    )


def tail_line() -> Column:
    """``seconds.nanos name k="v"..`` by label key."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), e["value"], F.lit('"'))), "")
    return F.concat(whole(F.col("ts_ns"), 10**9).cast("string"), F.lit("."), F.lpad((F.col("ts_ns") % 10**9).cast("string"), 9, "0"), F.lit(" "), "full_name", labels)


def json_row(columns: list[str]) -> Column:
    return F.to_json(F.struct(*columns))


def bridged(logs: DataFrame, promoted: list[str], most: int = 256) -> DataFrame:
    """Log lines (target, level, fields map) as forensic events; bridge targets are dropped.

    ``message`` leaves the fields, private ones are redacted, promoted ones are labels too.
    """
    rest = F.map_filter("fields", lambda k, v: (k != "message") & v.isNotNull())
    attrs = redact_map(F.transform_values(rest, lambda k, v: F.left(v, F.lit(most))))
    kept = logs.where(~F.col("target").startswith("obs.bridge")).withColumns({"message": F.col("fields")["message"], "attrs": attrs})
    return kept.withColumn("labels", F.map_filter("attrs", lambda k, v: k.isin(promoted)))


def first_match(rules: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rule that holds: how typed events are picked for log lines."""
    out = F.lit(None).cast("string")
    for name, hit in rules:
        out = F.coalesce(out, F.when(hit, F.lit(name)))
    return F.coalesce(out, F.lit(default))


def interned(events: DataFrame, callsite: list[str]) -> tuple[DataFrame, DataFrame]:
    """(events with ``callsite_id`` in place of the columns, dictionary of callsites)."""
    key = F.xxhash64(*callsite)
    return events.withColumn("callsite_id", key).drop(*callsite), events.select(*callsite).distinct().withColumn("callsite_id", key)


def self_events(rows: DataFrame, name: str, sev: str, labels: Column) -> DataFrame:
    """Rows about the pipeline itself; never filtered or sampled."""
    return rows.select(F.lit(f"obs.runtime.v1.{name}").alias("full_name"), F.lit("LOG").alias("tier"), F.lit(sev).alias("sev"), labels.alias("labels"), F.lit("RUNTIME").alias("sampling_reason"))
