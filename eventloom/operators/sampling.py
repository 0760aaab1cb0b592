"""Head sampling, size caps and routing: narrow decisions, one Column each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import hash_unit

BYPASS = ("FORENSIC", "AUDIT", "OVERRIDE")


def head_decision(default_rate: float, by_event: dict[str, float] | None = None, floor: int = 4, inbound: Column | None = None) -> Column:
    """Whether the head sampler keeps an event.

    A parent's decision comes first, then severities of ``floor`` or more, then the
    event's own rate, then the default.  The draw follows from the trace, so a trace's
    events are kept or dropped together.
    """
    rate = F.lit(default_rate)
    for name, own in (by_event or {}).items():
        rate = F.when(F.col("full_name") == name, own).otherwise(rate)
    own = (F.col("sev_rank") >= floor) | (hash_unit(F.col("trace_id")) < rate)
    return own if inbound is None else F.coalesce(inbound, own)


def sampled(envelopes: DataFrame, keep: Column, inbound: Column | None = None) -> DataFrame:
    """The kept envelopes; audit events and forced reasons always stay, with their reason."""
    forced = F.col("sampling_reason").isin(*BYPASS) | (F.col("tier") == "AUDIT")
    reason = F.when(F.col("tier") == "AUDIT", "AUDIT").otherwise(F.col("sampling_reason"))
    if inbound is not None:
        reason = F.when(inbound & ~forced, "OVERRIDE").otherwise(reason)
    return envelopes.where(forced | keep).withColumn("sampling_reason", reason)


def within_caps(payload: Column, labels: Column, most_payload: int = 256 << 10, most_label: int = 1 << 10) -> Column:
    """PAYLOAD, LABEL or null: the cap that an envelope breaks, payload first."""
    wide = F.exists(F.map_values(labels), lambda v: F.coalesce(F.octet_length(v) > most_label, F.lit(False)))
    return F.when(F.octet_length(payload) > most_payload, "PAYLOAD").when(wide, "LABEL")


def route(envelopes: DataFrame, sinks: dict[str, str], fallback: str) -> DataFrame:
    """``envelopes`` with the sink of their tier; audit events have no fallback."""
    target = F.lit(None).cast("string")
    for tier, sink in sinks.items():
        target = F.when(F.col("tier") == tier, sink).otherwise(target)
    return envelopes.withColumn("sink", F.when(F.col("tier") == "AUDIT", target).otherwise(F.coalesce(target, F.lit(fallback))))
