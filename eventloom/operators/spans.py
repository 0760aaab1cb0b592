"""Spans: Started/Completed pairs, orphans, records and inherited parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.operators.scan import summed_before


def paired(events: DataFrame, key: str, started: Column, completed: Column, timeout_ns: int, ts: str = "ts_ns", tie: str = "event_id", parts: int | None = None, least: int | None = None) -> DataFrame:
    """(key, start_*, end_*, matched) of every run of Started rows up to their Completed.

    A later Started overwrites an earlier one and a Completed consumes it, if it is
    younger than the timeout.  A run without a Completed has null end columns.  Runs are
    numbered by a prefix scan (``scan``), so one key with half of all rows is many tasks' work.
    """
    marked = summed_before(events.where(started | completed).withColumn("is_end", completed), [key], [ts, tie], F.col("is_end").cast("long"), "run", parts, least)
    at = F.struct(ts, tie)
    runs = marked.groupBy(key, "run").agg(
        F.max(F.when(~F.col("is_end"), at)).alias("s"), F.max(F.when(F.col("is_end"), at)).alias("e")
    )
    matched = F.coalesce(F.col("e")[ts] - F.col("s")[ts] <= timeout_ns, F.lit(False))
    return runs.select(key, F.col("s")[ts].alias("start_ns"), F.col("s")[tie].alias("start_id"), F.col("e")[ts].alias("end_ns"), F.col("e")[tie].alias("end_id"), matched.alias("matched"))


def completed_spans(pairs: DataFrame) -> DataFrame:
    """One row per Completed: its Started if it has one, and the duration."""
    mine = lambda c: F.when(F.col("matched"), F.col(c))
    return pairs.where("end_id is not null").withColumns({"start_ns": mine("start_ns"), "start_id": mine("start_id"), "duration_ns": mine("end_ns") - mine("start_ns")})


def orphans(pairs: DataFrame) -> DataFrame:
    """Started rows without a Completed in time."""
    return pairs.where("start_id is not null and not matched")


def span_records(envelopes: DataFrame, duration_ns: Column) -> DataFrame:
    """OTLP-like spans: the event's time is the end, errors set the status."""
    took = F.greatest(duration_ns, F.lit(0).cast("long"))
    return envelopes.withColumns({"start_ns": F.greatest(F.col("ts_ns") - took, F.lit(0).cast("long")), "end_ns": F.col("ts_ns"), "status": F.when(F.col("sev_rank") >= 5, "ERROR").otherwise("UNSET"), "kind": F.lit("INTERNAL")})


def inherited(spans: DataFrame) -> DataFrame:
    """``spans`` (span_id, parent_span_id, own_trace) with the trace of their parent, or their own.

    Of a repeated span id the least trace counts, so no row of ``spans`` is multiplied; the ids are
    folded on the key of the join, before its shuffle.
    """
    parents = spans.where("span_id is not null").groupBy(F.col("span_id").alias("of")).agg(F.min("own_trace").alias("parent_trace"))
    joined = spans.join(parents, spans.parent_span_id == parents["of"], "left")
    return joined.withColumn("trace_id", F.coalesce("parent_trace", "own_trace")).drop("of", "parent_trace")
