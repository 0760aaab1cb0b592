"""Event schemas: a small driver-side registry and the field tables made from it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from eventloom.functions.wire import id64
from eventloom.operators.governance import FIELDS


@dataclass(frozen=True)
class Field:
    name: str | None
    kind: str = "LABEL"
    cardinality: str = "LOW"
    classification: str = "INTERNAL"
    metric: str | None = None
    type: str = "string"
    tag: int = 0


@dataclass(frozen=True)
class EventSchema:
    full_name: str
    tier: str = "LOG"
    sev: str = "INFO"
    fields: tuple[Field, ...] = field(default_factory=tuple)

    @property
    def schema_hash(self) -> int:
        """An unsigned 64-bit id of name, tier, severity and fields in their order."""
        parts = ",".join(f"{f.name}:{f.kind}:{f.cardinality}:{f.classification}" for f in self.fields)
        return id64(f"{self.full_name}|{self.tier}|{self.sev}|{parts}")


def field_table(spark: SparkSession, every: list[EventSchema]) -> DataFrame:
    """One row per declared field; an event without fields has one row with null ones."""
    rows = [
        (s.full_name, f.tag or (i + 1 if f.name else None), f.name, f.kind, f.cardinality, f.classification, f.metric, f.type, s.tier)
        for s in every
        for i, f in enumerate(s.fields or (Field(None),))
    ]
    return spark.createDataFrame(rows, FIELDS)


def schema_table(spark: SparkSession, every: list[EventSchema]) -> DataFrame:
    """(full_name, schema_hash, tier, sev); the hash as 16 hex digits."""
    return spark.createDataFrame([(s.full_name, f"{s.schema_hash:016x}", s.tier, s.sev) for s in every], "full_name string, schema_hash string, tier string, sev string")


_LATENCY = Field("latency_ms", "MEASUREMENT", metric="histogram", type="long")
SCHEMAS = [
    EventSchema("shop.v1.ObsClick", "METRIC", "DEBUG", (Field("region"), _LATENCY)),
    EventSchema("shop.v1.ObsError", "LOG", "ERROR", (Field("region"), Field("reason", "ATTRIBUTE", "HIGH"))),
    EventSchema("shop.v1.ObsPurchase", "AUDIT", "INFO", (Field("region"), Field("amount", "ATTRIBUTE", type="long"))),
    EventSchema("shop.v1.ObsSignup", "LOG", "WARN", (Field("region"), Field("user_id", "ATTRIBUTE", "HIGH", "PII"))),
    EventSchema("shop.v1.ObsView", "TRACE", "TRACE", (Field("region"), Field("trace_id", "TRACE_ID"))),
]

#: Schemas that break a rule each.
BAD = [
    EventSchema("bad.v1.ObsEmpty"),
    EventSchema("bad.v1.Unprefixed", fields=(Field("status"),)),
    EventSchema("bad.v1.ObsLabels", fields=(Field("user", cardinality="HIGH"), Field("email", classification="PII"), Field("status", type="long"))),
    EventSchema("bad.v1.ObsSecret", fields=(Field("api_key", "ATTRIBUTE", classification="SECRET"), Field("took", "MEASUREMENT"))),
    EventSchema("bad.v1.ObsAudit", "AUDIT", fields=(Field("mail", "ATTRIBUTE", classification="PII"), Field("CamelCase"))),
    EventSchema("bad.v1.ObsSlots", "TRACE", fields=(Field("payload"), Field("trace", "TRACE_ID"), Field("span_id", "SPAN_ID", type="long"))),
]

#: Two versions of some schemas.
BASE = [
    EventSchema("app.v1.ObsA", fields=(Field("one", tag=1), Field("two", "ATTRIBUTE", "MEDIUM", tag=2), Field("three", "ATTRIBUTE", classification="PII", tag=3), Field("four", tag=4))),
    EventSchema("app.v1.ObsB", fields=(Field("one", tag=1),)),
]
HEAD = [
    EventSchema("app.v1.ObsA", fields=(Field("one", "ATTRIBUTE", tag=1), Field("two", "ATTRIBUTE", "HIGH", tag=2), Field("three", "ATTRIBUTE", tag=3), Field("five", tag=5))),
    EventSchema("app.v1.ObsC", fields=(Field("one", tag=1),)),
]
