"""Envelopes on their way out: identity, resources, text styles, OTLP text, log lines; and events made of spans and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import whole
from eventloom.operators.dimensions import small
from eventloom.operators.records import log_record
from eventloom.plans.storage import cut

#: Resource keys with a column of their own, in the table's order.
RESOURCE_SLOTS = {"service.namespace": "service_namespace", "deployment.environment": "environment", "host.name": "host_name", "host.arch": "host_arch"}
_ARCHES = {"x86_64": "amd64", "aarch64": "arm64"}


def _text(df: DataFrame, c: str) -> Column:
    """The column as text, empty where it is null or not there."""
    return F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")


def _dash(c: Column) -> Column:
    return F.when(c == "", "-").otherwise(c)


def identity_filled(envelopes: DataFrame, **identity: str) -> DataFrame:
    """``envelopes`` with service, instance and version filled where they are empty."""
    return envelopes.withColumns({c: F.coalesce(F.nullif(_text(envelopes, c), F.lit("")), F.lit(v)) for c, v in identity.items()})


def with_resource(envelopes: DataFrame, resource: dict[str, str]) -> DataFrame:
    """``envelopes`` with the resource on every row: a column a known key, the others as the map ``attrs``."""
    slots = {name: F.lit(_ARCHES.get(resource[key], resource[key]) if key == "host.arch" else resource[key]) if resource.get(key) else F.lit(None).cast("string") for key, name in RESOURCE_SLOTS.items()}
    rest = sorted((k, v) for k, v in resource.items() if k not in RESOURCE_SLOTS)
    attrs = F.create_map(*(F.lit(x) for kv in rest for x in kv)) if rest else F.create_map().cast("map<string,string>")
    return envelopes.withColumns({**slots, "attrs": attrs})


def with_resources(envelopes: DataFrame, sender: str, resources: dict) -> DataFrame:
    """``envelopes`` with their sender's resource on each row, in one pass: see ``with_resource``.

    ``resources``: a resource for each value of the column ``sender``; rows of other senders
    have no resource.
    """
    slot = lambda r, key: (_ARCHES.get(r[key], r[key]) if key == "host.arch" else r[key]) if r.get(key) else None
    rows = [(s, *(slot(r, key) for key in RESOURCE_SLOTS), {k: v for k, v in r.items() if k not in RESOURCE_SLOTS}) for s, r in resources.items()]
    kinds = [f"_sender {envelopes.schema[sender].dataType.simpleString()}", *(f"`{name}` string" for name in RESOURCE_SLOTS.values()), "attrs map<string,string>"]
    table = small(envelopes.sparkSession.createDataFrame(rows, ", ".join(kinds)))
    joined = envelopes.join(table, F.col(sender) == F.col("_sender"), "left").drop("_sender")
    return joined.withColumn("attrs", F.coalesce("attrs", F.create_map().cast("map<string,string>")))


def projected(rows: DataFrame, schema) -> DataFrame:
    """``rows`` of one event's typed fields with labels from its LABEL fields and its id fields lifted; empty values are left out."""
    mine = [f.name for f in schema.fields if f.kind == "LABEL"]
    every = F.map_from_arrays(F.array(*(F.lit(x) for x in mine)), F.array(*(F.col(x).cast("string") for x in mine)))
    lifted = {kind.lower(): F.col(f.name) for f in schema.fields for kind in ("TRACE_ID", "SPAN_ID", "PARENT_SPAN_ID") if f.kind == kind}
    return rows.withColumns({"full_name": F.lit(schema.full_name), "labels": F.map_filter(every, lambda k, v: v.isNotNull() & (v != "")), **lifted})


def dispatched(envelopes: DataFrame, events: dict[str, list[str]]) -> DataFrame:
    """``envelopes`` with a struct column for each event, null on rows of other events."""
    return envelopes.withColumns({"payload_" + e.lower().replace(".", "_"): F.when(F.col("full_name") == e, F.struct(*columns)) for e, columns in events.items()})


def _by_key(labels: Column, one) -> Column:
    return F.transform(F.array_sort(F.map_entries(labels)), one)


def full_lines(envelopes: DataFrame, payload: str | None = None) -> Column:
    """Several lines an event: times, names, identity, ids, a line a label and the payload's size."""
    t = lambda c: _text(envelopes, c)
    head = F.format_string("[%10d.%09d %-5s] %-6s %s", whole(F.col("ts_ns"), 10**9), F.col("ts_ns") % 10**9, t("sev"), t("tier"), t("full_name"))
    who = F.concat(F.lit("  service="), _dash(t("service")), F.lit(" instance="), _dash(t("instance")), F.lit(" version="), _dash(t("version")), F.lit(" reason="), t("sampling_reason"))
    ids = F.concat(F.lit("  trace_id="), _dash(t("trace_id")), F.lit(" span_id="), _dash(t("span_id")), F.lit(" parent="), _dash(t("parent_span_id")))
    labels = _by_key(F.col("labels"), lambda e: F.concat(F.lit("  label."), e["key"], F.lit("="), e["value"]))
    size = F.octet_length(payload) if payload else F.lit(0)
    parts = F.concat(F.array(head, who, F.when((t("trace_id") != "") | (t("span_id") != ""), ids)), labels, F.array(F.when(size > 0, F.concat(F.lit("  payload_bytes="), size.cast("string")))))
    return F.array_join(F.array_compact(parts), "\n")


def pretty_lines(envelopes: DataFrame, payload: str | None = None) -> Column:
    """Several indented lines an event under a ruled head."""
    t = lambda c: _text(envelopes, c)
    head = F.format_string("─── %s @ %d.%09d %s %s ───", t("full_name"), whole(F.col("ts_ns"), 10**9), F.col("ts_ns") % 10**9, t("sev"), t("tier"))
    who = F.concat(F.lit("    service: "), t("service"), F.lit(" ("), t("version"), F.lit(") instance: "), t("instance"))
    trace = F.concat(F.lit("    trace:   "), t("trace_id"), F.lit("/"), t("span_id"), F.lit(" parent="), t("parent_span_id"))
    labels = _by_key(F.col("labels"), lambda e: F.concat(F.lit("        "), e["key"], F.lit(" = "), e["value"]))
    size = F.octet_length(payload) if payload else F.lit(0)
    parts = F.concat(
        F.array(head, who, F.when(t("trace_id") != "", trace), F.when(F.size("labels") > 0, F.lit("    labels:"))), labels,
        F.array(F.when(size > 0, F.concat(F.lit("    payload: "), size.cast("string"), F.lit(" bytes")))),
    )
    return F.array_join(F.array_compact(parts), "\n")


def json_lines(envelopes: DataFrame) -> Column:
    """One JSON object an event, its keys in order; empty slots, zero ids and empty labels are left out."""
    names = sorted({"ts_ns", "sev", "tier", "full_name", "service", "instance", "version", "trace_id", "span_id", "parent_span_id", "schema_hash", "callsite_id", "labels"} & set(envelopes.columns))
    shown = []
    for c in names:
        kind = envelopes.schema[c].dataType.simpleString()
        if kind == "string":
            shown.append(F.nullif(F.col(c), F.lit("")).alias(c))
        elif c == "labels":
            shown.append(F.when(F.size(c) > 0, F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c))
        else:
            shown.append((F.col(c) if c == "ts_ns" else F.nullif(F.col(c), F.lit(0).cast(kind))).alias(c))
    return F.to_json(F.struct(*shown))


def key_values(attributes: Column) -> Column:
    """A text map as OTLP key-values, by key."""
    return _by_key(attributes, lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def payload_key_values(df: DataFrame, fields: dict[str, str]) -> Column:
    """OTLP key-values of typed payload columns (name: class); classified ones are a marker, nulls are left out."""
    out = []
    for c, kind in fields.items():
        of = df.schema[c].dataType.simpleString()
        text, whole_number, real = (F.lit(None).cast("string"),) * 2 + (F.lit(None).cast("double"),)
        if kind in ("PII", "SECRET"):
            text = F.lit("<redacted>")
        elif of in ("tinyint", "smallint", "int", "bigint"):
            whole_number = F.col(c).cast("string")
        elif of in ("float", "double"):
            real = F.col(c).cast("double")
        else:
            text = F.col(c).cast("string")
        value = F.struct(real.alias("doubleValue"), whole_number.alias("intValue"), text.alias("stringValue"))
        out.append(F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("key"), value.alias("value"))))
    return F.array_compact(F.array(*out))


def otlp_logs(envelopes: DataFrame, name: str = "record") -> DataFrame:
    """``envelopes`` and the log record of each as OTLP/JSON text."""
    at = F.col("ts_ns").cast("string")
    record = F.struct(
        at.alias("timeUnixNano"), at.alias("observedTimeUnixNano"), F.col("severity_number").alias("severityNumber"), F.col("severity_text").alias("severityText"),
        key_values(F.col("attributes")).alias("attributes"), F.nullif(F.col("trace_id"), F.lit("")).alias("traceId"), F.nullif(F.col("span_id"), F.lit("")).alias("spanId"),
    )
    return log_record(envelopes).select(*envelopes.columns, F.to_json(record).alias(name))


def otlp_points(points: DataFrame, name: str = "record") -> DataFrame:
    """``points`` (metric, point, ts_ns, labels) and each as an OTLP/JSON gauge metric."""
    data = F.struct(F.col("ts_ns").cast("string").alias("timeUnixNano"), F.col("point").alias("asDouble"), key_values(F.col("labels")).alias("attributes"))
    record = F.struct(F.col("metric").alias("name"), F.struct(F.array(data).alias("dataPoints")).alias("gauge"))
    return points.withColumn(name, F.to_json(record))


def otlp_spans(spans: DataFrame, name: str = "record") -> DataFrame:
    """``spans`` (start_ns, end_ns, status, ..) and each as an OTLP/JSON span of kind INTERNAL."""
    own = F.map_concat(F.map_filter("labels", lambda k, v: k != "event.name"), F.create_map(F.lit("event.name"), F.col("full_name")))
    record = F.struct(
        F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("full_name").alias("name"), F.lit(1).alias("kind"),
        F.col("start_ns").cast("string").alias("startTimeUnixNano"), F.col("end_ns").cast("string").alias("endTimeUnixNano"),
        key_values(own).alias("attributes"), F.struct(F.when(F.col("status") == "ERROR", 2).otherwise(0).alias("code")).alias("status"),
    )
    return spans.withColumn(name, F.to_json(record))


def log_lines(envelopes: DataFrame, payload: str | None = None) -> DataFrame:
    """Envelopes as log lines (target, level, fields map, message): what a plain logger gets.

    FATAL has no level of its own there; the message is the payload where it is printable.
    """
    t = lambda c: _text(envelopes, c)
    site = F.concat(F.lit("0x"), F.lower(F.lpad(F.hex("callsite_id"), 16, "0"))) if "callsite_id" in envelopes.columns else F.lit("")
    labels = F.array_join(_by_key(F.col("labels"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    pairs = {"obs.full_name": t("full_name"), "obs.trace_id": t("trace_id"), "obs.span_id": t("span_id"), "obs.parent_span_id": t("parent_span_id"), "obs.callsite_id": site, "obs.labels": labels}
    fields = F.map_filter(F.create_map(*(x for k, v in pairs.items() for x in (F.lit(k), v))), lambda k, v: v != "")
    message = F.when(~F.col(payload).rlike(r"[\x00-\x08\x0B-\x1F\x7F-\x9F]"), F.col(payload)) if payload else F.lit(None).cast("string")
    return envelopes.select("*", F.col("full_name").alias("target"), F.when(F.col("sev") == "FATAL", "ERROR").otherwise(F.col("sev")).alias("level"), fields.alias("fields"), message.alias("message"))


def closed_spans(opened: DataFrame, closed: DataFrame) -> DataFrame:
    """A completed event for each span of ``opened`` (span_id, name, target, ..) that ``closed`` (span_id, closed_ns) ends."""
    c = closed.select(F.col("span_id").alias("of"), "closed_ns")
    joined = opened.join(c, opened.span_id == c["of"]).drop("of")
    labels = F.create_map(F.lit("name"), F.col("name"), F.lit("target"), F.col("target"))
    own = {"full_name": F.lit("obs.v1.ObsSpanCompleted"), "tier": F.lit("LOG"), "sev": F.lit("DEBUG"), "labels": labels, "latency_ns": F.greatest(F.col("closed_ns") - F.col("ts_ns"), F.lit(0).cast("long")), "ts_ns": F.col("closed_ns")}
    return joined.withColumns(own).drop("closed_ns")


def root_traces(spans: DataFrame) -> DataFrame:
    """``spans`` (span_id, parent_span_id, own_trace) with ``trace_id``: that of the outermost known ancestor.

    Each round doubles the height that is looked up, so a tree of depth n takes log n joins.
    A span that is or has an ancestor in a cycle of parents keeps its own trace: after as many
    rounds as reach over all spans, what still climbs goes round.  Rows that repeat a span id
    are all kept and count as one span, that of the least parent (null first) and then of the least trace.
    """
    one = spans.where(F.col("span_id").isNotNull()).groupBy("span_id").agg(F.min(F.struct("parent_span_id", "own_trace")).alias("s"))
    state = cut(one.select("span_id", F.col("s.parent_span_id").alias("up"), F.col("s.own_trace").alias("trace"), F.col("s.own_trace").alias("own")))
    for _ in range(max(state.count(), 1).bit_length() + 1):
        above = state.select(F.col("span_id").alias("at"), F.col("up").alias("next"), F.col("trace").alias("inherited"))
        joined = state.join(above, state.up == above["at"], "left")
        state = cut(joined.select("span_id", F.col("next").alias("up"), F.coalesce("inherited", "trace").alias("trace"), "own"))
        if state.where("up is not null").isEmpty():
            break
    found = state.select(F.col("span_id").alias("of"), F.when(F.col("up").isNull(), F.col("trace")).otherwise(F.col("own")).alias("trace_id"))
    return spans.join(found, spans.span_id == found["of"], "left").select(*spans.columns, F.coalesce("trace_id", "own_trace").alias("trace_id"))


def call_events(calls: DataFrame, entered: bool = False) -> DataFrame:
    """Events of function calls (fn_name, started_ns, ended_ns): one when a call ends, and if wanted one when it starts."""
    labels = F.create_map(F.lit("fn_name"), F.col("fn_name"))
    kinds = [("obs.v1.ObsFnExecuted", "INFO", F.col("ended_ns"), F.col("ended_ns") - F.col("started_ns"))]
    if entered:
        kinds.append(("obs.v1.ObsFnEntered", "DEBUG", F.col("started_ns"), F.lit(None).cast("long")))
    rows = F.array(*(F.struct(F.lit(n).alias("full_name"), F.lit(s).alias("sev"), at.alias("ts_ns"), took.alias("latency_ns")) for n, s, at, took in kinds))
    return calls.select("*", labels.alias("labels"), F.lit("LOG").alias("tier"), F.explode(rows).alias("e")).select(*calls.columns, "labels", "tier", "e.*")


def forensic_events(notes: DataFrame) -> DataFrame:
    """Free-form notes (site, message, attrs map) as events: attrs are labels beside the site, the message is the payload."""
    labels = F.map_concat(F.map_filter(F.create_map(F.lit("site"), F.col("site")), lambda k, v: ~F.map_contains_key("attrs", k)), F.col("attrs"))
    own = {"full_name": "obs.v1.ObsForensicEvent", "tier": "LOG", "sev": "INFO", "sampling_reason": "FORENSIC"}
    return notes.withColumns({**{k: F.lit(v) for k, v in own.items()}, "labels": labels, "payload": F.encode("message", "UTF-8")})


def http_pairs(requests: DataFrame, side: str = "server") -> DataFrame:
    """A started and a completed event for each request (method, route, status, started_ns, took_ns)."""
    from eventloom.functions.text import status_class

    name = "Request" if side == "server" else "Client"
    base = F.create_map(F.lit("method"), F.col("method"), F.lit("route"), F.col("route"))
    done = F.map_concat(base, F.create_map(F.lit("status_class"), status_class(F.col("status"))))
    started = F.struct(F.lit(f"obs.v1.ObsHttp{name}Started").alias("full_name"), F.col("started_ns").alias("ts_ns"), base.alias("labels"), F.lit(None).cast("long").alias("latency_ns"))
    completed = F.struct(F.lit(f"obs.v1.ObsHttp{name}Completed").alias("full_name"), (F.col("started_ns") + F.col("took_ns")).alias("ts_ns"), done.alias("labels"), F.col("took_ns").alias("latency_ns"))
    return requests.select("*", F.explode(F.array(started, completed)).alias("e")).select(*requests.columns, "e.*")
