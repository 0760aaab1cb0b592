"""Queries of what leaves the pipeline and of the scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.envelope import ENV_SQL, labels_text
from eventloom.operators import dimensions, exports, metrics, records, spans
from eventloom.plans.event_queries import env, event_query, table
from eventloom.plans.registry import query
from eventloom.plans.storage import shared_path
from eventloom.sinks import tables
from eventloom.sources import ndjson, schemas, spool

# Projections.

RESOURCE = {"service.namespace": "payments", "deployment.environment": "staging", "host.name": "host-7", "host.arch": "aarch64", "k8s.cluster.name": "alpha", "cloud.region": "west"}


def _identified(e: DataFrame) -> DataFrame:
    bare = e.withColumns({"service": F.when(F.col("service") == "batch", "").otherwise(F.col("service")), "instance": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("i-"), F.col("event_id") % 4)), "parent_span_id": F.when(F.col("event_id") % 3 == 0, F.substring("trace_id", 1, 16)).otherwise("")})
    return exports.identity_filled(bare, service="shop", instance="i-0", version="1.2.3")


_IDENTIFIED = """, idd AS (SELECT *, CASE WHEN service = 'batch' THEN 'shop' ELSE service END AS svc, CASE WHEN event_id % 2 = 0 THEN 'i-' || (event_id % 4) ELSE 'i-0' END AS instance, '1.2.3' AS version,
    CASE WHEN event_id % 3 = 0 THEN substr(trace_id, 1, 16) ELSE '' END AS parent FROM env) """


@event_query("pj03_identity_fill", _IDENTIFIED + "SELECT event_id, svc AS service, instance, version FROM idd")
def identity(e: DataFrame) -> DataFrame:
    return _identified(e).select("event_id", "service", "instance", "version")


@event_query(
    "pj05_resource_columns",
    "SELECT event_id, full_name, 'payments' AS service_namespace, 'staging' AS environment, 'host-7' AS host_name, 'arm64' AS host_arch, 'cloud.region=west,k8s.cluster.name=alpha' AS attrs FROM env",
)
def resource_columns(e: DataFrame) -> DataFrame:
    return exports.with_resource(e, RESOURCE).select("event_id", "full_name", *exports.RESOURCE_SLOTS.values(), labels_text(F.col("attrs")).alias("attrs"))


@event_query(
    "jn05_resource_per_batch",
    "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'prod' WHEN 1 THEN 'dev' END AS environment, CASE event_id % 3 WHEN 0 THEN 'h-0' ELSE 'h-1' END AS host_name, CASE WHEN event_id % 3 = 2 THEN 'team=a' ELSE '' END AS attrs FROM env",
)
def resource_per_batch(e: DataFrame) -> DataFrame:
    """Each batch has its sender's resource on all of its rows."""
    senders = [{"deployment.environment": "prod", "host.name": "h-0"}, {"deployment.environment": "dev", "host.name": "h-1"}, {"host.name": "h-1", "team": "a"}]
    made = exports.with_resources(e.withColumn("sender", F.col("event_id") % 3), "sender", dict(enumerate(senders)))
    return made.select("event_id", "environment", "host_name", labels_text(F.col("attrs")).alias("attrs"))


_SHOP = schemas.EventSchema("shop.v1.ObsTyped", fields=(schemas.Field("event_type"), schemas.Field("region_id"), schemas.Field("amount", "ATTRIBUTE"), schemas.Field("trace", "TRACE_ID"), schemas.Field("span", "SPAN_ID")))


@event_query("pj02_label_projection", "SELECT event_id, 'shop.v1.ObsTyped' AS full_name, CASE WHEN user_id % 5 = 0 THEN 'event_type=' || event_type ELSE 'event_type=' || event_type || ',region_id=' || region END AS labels, trace_id, span_id FROM env")
def label_projection(e: DataFrame) -> DataFrame:
    rows = e.select("event_id", F.col("labels")["event_type"].alias("event_type"), F.nullif(F.col("user_id") % 5, F.lit(0)).alias("region_id"), F.col("value").alias("amount"), F.col("trace_id").alias("trace"), F.col("span_id").alias("span"))
    return exports.projected(rows, _SHOP).select("event_id", "full_name", labels_text(F.col("labels")).alias("labels"), "trace_id", "span_id")


@event_query("pj07_payload_json", """SELECT event_id, '{"k":' || k || ',"user_id":' || user_id || ',"props":' || to_json(props) || '}' AS payload FROM env""")
def payload_json(e: DataFrame) -> DataFrame:
    return e.select("event_id", records.json_row(["k", "user_id", "props"]).alias("payload"))


@event_query(
    "pj08_payload_key_values",
    """SELECT event_id, '[{"key":"k","value":{"intValue":"' || k || '"}},{"key":"value","value":{"doubleValue":' || CAST(value AS VARCHAR) || '}},{"key":"service","value":{"stringValue":"' || service || '"}},{"key":"user_id","value":{"stringValue":"<redacted>"}}]' AS pairs FROM env""",
)
def payload_pairs(e: DataFrame) -> DataFrame:
    return e.select("event_id", F.to_json(exports.payload_key_values(e, {"k": "INTERNAL", "value": "INTERNAL", "service": "INTERNAL", "user_id": "PII"})).alias("pairs"))


_S, _N = "CAST(ts_ns // 1000000000 AS VARCHAR)", "lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0')"
_LABEL_LINES = "'{0}bucket{1}' || bucket || chr(10) || '{0}event_type{1}' || event_type || chr(10) || '{0}region{1}' || region"


@event_query(
    "pj13_full_lines",
    _IDENTIFIED
    + f"""SELECT event_id, '[' || lpad({_S}, 10, ' ') || '.' || {_N} || ' ' || rpad(sev, 5, ' ') || '] ' || rpad(tier, 6, ' ') || ' ' || full_name || chr(10) || '  service=' || svc || ' instance=' || instance || ' version=1.2.3 reason=HEAD_RATE' || chr(10)
    || '  trace_id=' || trace_id || ' span_id=' || span_id || ' parent=' || CASE parent WHEN '' THEN '-' ELSE parent END || chr(10) || {_LABEL_LINES.format("  label.", "=")} || chr(10) || '  payload_bytes=' || octet_length(encode(props)) AS line FROM idd""",
)
def full_text(e: DataFrame) -> DataFrame:
    e = _identified(e)
    return e.select("event_id", exports.full_lines(e, "props").alias("line"))


@event_query(
    "pj13_pretty_lines",
    _IDENTIFIED
    + f"""SELECT event_id, '─── ' || full_name || ' @ ' || {_S} || '.' || {_N} || ' ' || sev || ' ' || tier || ' ───' || chr(10) || '    service: ' || svc || ' (1.2.3) instance: ' || instance || chr(10)
    || '    trace:   ' || trace_id || '/' || span_id || ' parent=' || parent || chr(10) || '    labels:' || chr(10) || {_LABEL_LINES.format("        ", " = ")} AS line FROM idd""",
)
def pretty_text(e: DataFrame) -> DataFrame:
    e = _identified(e)
    return e.select("event_id", exports.pretty_lines(e).alias("line"))


@event_query(
    "pj13_json_lines",
    _IDENTIFIED
    + """SELECT event_id, '{"full_name":"' || full_name || '","instance":"' || instance || '","labels":{"bucket":"' || bucket || '","event_type":"' || event_type || '","region":"' || region || '"}' || CASE parent WHEN '' THEN '' ELSE ',"parent_span_id":"' || parent || '"' END
    || ',"service":"' || svc || '","sev":"' || sev || '","span_id":"' || span_id || '","tier":"' || tier || '","trace_id":"' || trace_id || '","ts_ns":' || ts_ns || ',"version":"1.2.3"}' AS line FROM idd""",
)
def json_text(e: DataFrame) -> DataFrame:
    e = _identified(e)
    return e.select("event_id", exports.json_lines(e).alias("line"))


@event_query("pj22_select_format", """SELECT event_id, 'json' AS format, '{"full_name":"' || full_name || '","sev":"' || sev || '"}' AS line FROM env WHERE sev_rank >= 5 UNION ALL SELECT event_id, 'text', full_name || ' ' || sev FROM env WHERE sev_rank >= 5""")
def select_format(e: DataFrame) -> DataFrame:
    picked = ndjson.query(e, severity="error", select=["event_id", "full_name", "sev"])
    shown = {"json": records.json_row(["full_name", "sev"]), "text": F.concat_ws(" ", "full_name", "sev")}
    rows = F.array(*(F.struct(F.lit(k).alias("format"), v.alias("line")) for k, v in shown.items()))
    return picked.select("event_id", F.explode(rows).alias("x")).select("event_id", "x.*")


@event_query(
    "pj24_self_events",
    "SELECT full_name, sev, tier, sampling_reason, labels, n FROM (SELECT 'obs.runtime.v1.ObsEventDropped' AS full_name, 'WARN' AS sev, 'LOG' AS tier, 'RUNTIME' AS sampling_reason, 'event=' || full_name || ',reason=size' AS labels, count(*) AS n FROM env WHERE k > 50 GROUP BY full_name)",
)
def runtime_events(e: DataFrame) -> DataFrame:
    own = records.self_events(e.where("k > 50"), "ObsEventDropped", "WARN", F.create_map(F.lit("event"), F.col("full_name"), F.lit("reason"), F.lit("size")))
    return own.groupBy("full_name", "sev", "tier", "sampling_reason", labels_text(F.col("labels")).alias("labels")).agg(F.count("*").alias("n"))


# Spans, calls, notes, requests.


@event_query(
    "pj16_root_traces",
    "SELECT e.event_id, r.trace_id FROM env e JOIN env r ON r.event_id = e.event_id - e.event_id % 64",
)
def roots(e: DataFrame) -> DataFrame:
    """Binary trees of 64 spans each: every span has its root's trace, six levels up at most."""
    place, base = F.col("event_id") % 64, F.col("event_id") - F.col("event_id") % 64
    parent = F.when(place > 0, F.substring(F.md5((base + F.floor(place / 2)).cast("string")), 1, 16))
    return exports.root_traces(e.select("event_id", "span_id", parent.alias("parent_span_id"), F.col("trace_id").alias("own_trace"))).select("event_id", "trace_id")


# Sinks.


@event_query(
    "sk17_otlp_logs",
    """SELECT event_id, '{"timeUnixNano":"' || ts_ns || '","observedTimeUnixNano":"' || ts_ns || '","severityNumber":' || [1, 5, 9, 13, 17, 21][sev_rank] || ',"severityText":"' || sev || '","attributes":[' ||
    list_aggregate([ '{"key":"' || x[1] || '","value":{"stringValue":"' || x[2] || '"}}' FOR x IN [['bucket', bucket], ['event.name', full_name], ['event_type', event_type], ['obs.sampling_reason', 'HEAD_RATE'], ['region', region]] ], 'string_agg', ',')
    || '],"traceId":"' || trace_id || '","spanId":"' || span_id || '"}' AS record FROM env""",
)
def otlp_logs(e: DataFrame) -> DataFrame:
    return exports.otlp_logs(e).select("event_id", "record")


@event_query(
    "sk17_otlp_points",
    """SELECT event_id, '{"name":"latency","gauge":{"dataPoints":[{"timeUnixNano":"' || ts_ns || '","asDouble":' || CAST(value AS VARCHAR) || ',"attributes":[{"key":"bucket","value":{"stringValue":"' || bucket || '"}},{"key":"event_type","value":{"stringValue":"' || event_type || '"}},{"key":"region","value":{"stringValue":"' || region || '"}}]}]}}' AS record FROM env WHERE tier = 'METRIC'""",
)
def otlp_points(e: DataFrame) -> DataFrame:
    return exports.otlp_points(records.metric_points(e.where("tier = 'METRIC'"), {"value": "latency"})).select("event_id", "record")


@event_query(
    "sk18_otlp_spans",
    """SELECT event_id, '{"traceId":"' || trace_id || '","spanId":"' || span_id || '","name":"' || full_name || '","kind":1,"startTimeUnixNano":"' || (ts_ns - k * 1000000) || '","endTimeUnixNano":"' || ts_ns || '","attributes":[{"key":"bucket","value":{"stringValue":"' || bucket || '"}},{"key":"event.name","value":{"stringValue":"' || full_name
    || '"}},{"key":"event_type","value":{"stringValue":"' || event_type || '"}},{"key":"region","value":{"stringValue":"' || region || '"}}],"status":{"code":' || CASE WHEN sev_rank >= 5 THEN 2 ELSE 0 END || '}}' AS record FROM env WHERE tier IN ('TRACE', 'LOG')""",
)
def otlp_spans(e: DataFrame) -> DataFrame:
    return exports.otlp_spans(spans.span_records(e.where("tier in ('TRACE', 'LOG')"), F.col("k") * 1000000)).select("event_id", "record")


@event_query(
    "sk22_log_lines",
    "SELECT event_id, full_name AS target, CASE sev WHEN 'FATAL' THEN 'ERROR' ELSE sev END AS level, 'obs.callsite_id=0x' || lower(lpad(hex(event_id), 16, '0')) || ',obs.full_name=' || full_name || ',obs.labels=' || labels_text || ',obs.span_id=' || span_id || ',obs.trace_id=' || trace_id AS fields, CASE WHEN event_id % 2 = 0 THEN props END AS message FROM env",
)
def bridge_lines(e: DataFrame) -> DataFrame:
    payload = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("\b\x01"), "props"))
    found = exports.log_lines(e.withColumns({"callsite_id": F.col("event_id"), "payload": payload}), "payload")
    return found.select("event_id", "target", "level", labels_text(F.col("fields")).alias("fields"), "message")


@query("sk02_partition_paths", ENV_SQL + "SELECT service, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM env GROUP BY ALL")
def partition_paths(spark: SparkSession, d: str) -> DataFrame:
    """Partition values read back from the paths of the files."""
    at = shared_path(spark, "hours")
    tables.write(env(spark, d), at, by=("service", "date", "hour"))
    part = lambda c: F.regexp_extract(F.input_file_name(), f"/{c}=([^/]*)/", 1)
    paths = spark.read.parquet(at).select(part("service").alias("service"), part("date").alias("date"), part("hour").cast("int").alias("hour"))
    return paths.groupBy("service", "date", "hour").agg(F.count("*").alias("n"))


_CODECS = ("snappy", "zstd", "lz4", "uncompressed")


@query("sk05_codecs", ENV_SQL + "SELECT codec, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM env, (VALUES " + ", ".join(f"('{c}')" for c in _CODECS) + ") c(codec) GROUP BY codec")
def codecs(spark: SparkSession, d: str) -> DataFrame:
    made = None
    for codec in _CODECS:
        at = shared_path(spark, codec)
        tables.write(env(spark, d).select("event_id", "service", "ts_ns", "span_id", "k"), at, codec=codec)
        one = tables.read(spark, at).groupBy(F.lit(codec).alias("codec")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))
        made = one if made is None else made.unionByName(one)
    return made


@query("sk14_fan_out", ENV_SQL + "SELECT sink, tier, count(*) AS n FROM env, (VALUES ('first'), ('second')) s(sink) GROUP BY ALL")
def fan_out(spark: SparkSession, d: str) -> DataFrame:
    source, first, second = (shared_path(spark, x) for x in ("source", "first", "second"))
    schema = "event_id long, tier string"
    env(spark, d).select("event_id", "tier").write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    q = stream.writeStream.foreachBatch(tables.fan_out([tables.put_batch(first), tables.put_batch(second)])).option("checkpointLocation", f"{first}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    both = [spark.read.schema(schema).parquet(at).withColumn("sink", F.lit(name)) for name, at in (("first", first), ("second", second))]
    return both[0].unionByName(both[1]).groupBy("sink", "tier").agg(F.count("*").alias("n"))


@event_query("sk16_noop", "SELECT tier, count(*) AS n FROM env GROUP BY tier")
def noop(e: DataFrame) -> DataFrame:
    """The sink takes all rows and keeps none; the rows are the same after it."""
    e.write.format("noop").mode("overwrite").save()
    return e.groupBy("tier").agg(F.count("*").alias("n"))


_SESSIONS = "SELECT user_id AS id, region AS key, min(ts_ns) AS since_ns, max(ts_ns) AS last_ns FROM env GROUP BY user_id, region"
_NOW, _IDLE = 1706659200 * 10**9, 6 * 3600 * 10**9


def _sessions(e: DataFrame) -> DataFrame:
    return e.groupBy(F.col("user_id").alias("id"), F.col("labels")["region"].alias("key")).agg(F.min("ts_ns").alias("since_ns"), F.max("ts_ns").alias("last_ns"))


_STATES = f""", s AS ({_SESSIONS}), a AS (SELECT *, last_ns >= {_NOW - _IDLE} AS live FROM s), b AS (SELECT *, live AND row_number() OVER (PARTITION BY key, live ORDER BY since_ns, id) <= 12 AS fits FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY fits ORDER BY since_ns, id) AS nth FROM b), d AS (SELECT *, CASE WHEN NOT live THEN 'idle' WHEN NOT fits THEN 'over key cap' WHEN nth > 40 THEN 'over cap' ELSE 'live' END AS state FROM c) """


@event_query("sr10_subscriber_expiry", _STATES + "SELECT id, state FROM d")
def expiry(e: DataFrame) -> DataFrame:
    return dimensions.kept_subscribers(_sessions(e), "key", _NOW, _IDLE, 40, 12).select("id", "state")


@event_query("sk20_live_tail", _STATES + "SELECT d.id AS subscriber, least(count(*), 100) AS delivered, greatest(count(*) - 100, 0) AS dropped FROM d JOIN env e ON e.region = d.key AND e.sev_rank >= 5 WHERE state = 'live' GROUP BY d.id")
def live_tail(e: DataFrame) -> DataFrame:
    """Live subscribers of a label get its errors, up to a buffer's size each."""
    live = F.broadcast(dimensions.kept_subscribers(_sessions(e), "key", _NOW, _IDLE, 40, 12).where("state = 'live'").select(F.col("id").alias("subscriber"), "key"))  # 40 rows at most
    hits = e.where("sev_rank >= 5").select(F.col("labels")["region"].alias("of")).join(live, F.col("of") == F.col("key"))
    n = F.count("*")
    return hits.groupBy("subscriber").agg(F.least(n, F.lit(100)).alias("delivered"), F.greatest(n - 100, F.lit(0).cast("long")).alias("dropped"))


@event_query("sr09_series_expiry", f"SELECT full_name, region, max(ts_ns) AS last_ns, max(ts_ns) >= {_NOW - 3600 * 10**9} AS alive FROM env GROUP BY ALL")
def series_expiry(e: DataFrame) -> DataFrame:
    return metrics.alive(e.withColumn("region", F.col("labels")["region"]), ["full_name", "region"], "ts_ns", _NOW, 3600 * 10**9)


@query("sc14_parquet_source", ENV_SQL + "SELECT event_id, full_name FROM env WHERE service = 'api' AND sev_rank >= 4")
def parquet_source(spark: SparkSession, d: str) -> DataFrame:
    at = shared_path(spark, "stored")
    tables.write(env(spark, d), at)
    return ndjson.query(tables.read(spark, at).where("service = 'api'"), severity="warn", select=["event_id", "full_name"])


@event_query("sc12_log_source", "SELECT event_id, 'obs.v1.ObsForensicEvent' AS full_name, 'seen ' || event_id AS message, 'region=' || region || ',site=app::shop' AS labels FROM env WHERE event_id % 7 > 0")
def log_source(e: DataFrame) -> DataFrame:
    """Lines of a plain logger as forensic events; the bridge's own lines are dropped."""
    target = F.when(F.col("event_id") % 7 == 0, "obs.bridge").otherwise("app::shop")
    made = F.create_map(F.lit("message"), F.concat(F.lit("seen "), F.col("event_id").cast("string")), F.lit("region"), F.col("labels")["region"])
    logs = records.bridged(e.select("event_id", target.alias("target"), made.alias("fields")), ["region"])
    found = exports.forensic_events(logs.select("event_id", F.col("target").alias("site"), "message", "attrs"))
    return found.select("event_id", "full_name", F.decode("payload", "UTF-8").alias("message"), labels_text(F.col("labels")).alias("labels"))


@event_query("pj21_forensic_events", "SELECT event_id, 'obs.v1.ObsForensicEvent' AS full_name, 'INFO' AS sev, 'LOG' AS tier, 'FORENSIC' AS sampling_reason, 'service=' || service || ',site=' || CASE WHEN k > 90 THEN 'override' ELSE region || '.rs' END AS labels, hex(encode(props)) AS payload FROM env")
def forensic(e: DataFrame) -> DataFrame:
    own = F.create_map(F.lit("service"), F.col("service"))
    attrs = F.when(F.col("k") > 90, F.map_concat(own, F.create_map(F.lit("site"), F.lit("override")))).otherwise(own)
    notes = e.select("event_id", F.concat(F.col("labels")["region"], F.lit(".rs")).alias("site"), F.col("props").alias("message"), attrs.alias("attrs"))
    return exports.forensic_events(notes).select("event_id", "full_name", "sev", "tier", "sampling_reason", labels_text(F.col("labels")).alias("labels"), F.hex("payload").alias("payload"))


_ROUTE = "regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1)"


@query(
    "sc13_http_requests",
    f"""SELECT page_id, 'obs.v1.ObsHttp' || side || 'Started' AS full_name, page_id * 1000 AS ts_ns, 'method=GET,route=' || {_ROUTE} AS labels, CAST(NULL AS BIGINT) AS latency_ns FROM pages, (VALUES ('Request'), ('Client')) s(side)
    UNION ALL SELECT page_id, 'obs.v1.ObsHttp' || side || 'Completed', page_id * 1000 + page_id % 50, 'method=GET,route=' || {_ROUTE} || ',status_class=' || CASE WHEN (page_id % 7) * 100 BETWEEN 100 AND 599 THEN (page_id % 7) || 'xx' ELSE 'err' END, page_id % 50 FROM pages, (VALUES ('Request'), ('Client')) s(side)""",
)
def http_requests(spark: SparkSession, d: str) -> DataFrame:
    route = F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)?", 1)
    asked = table(spark, d, "pages").select("page_id", F.lit("GET").alias("method"), route.alias("route"), ((F.col("page_id") % 7) * 100).alias("status"), (F.col("page_id") * 1000).alias("started_ns"), (F.col("page_id") % 50).alias("took_ns"))
    both = exports.http_pairs(asked, "server").unionByName(exports.http_pairs(asked, "client"))
    return both.select("page_id", "full_name", "ts_ns", labels_text(F.col("labels")).alias("labels"), "latency_ns")


@event_query(
    "pj20_call_events",
    "SELECT event_id, 'obs.v1.ObsFnExecuted' AS full_name, 'INFO' AS sev, ts_ns + k AS ts_ns, k AS latency_ns, 'fn_name=' || service AS labels FROM env UNION ALL SELECT event_id, 'obs.v1.ObsFnEntered', 'DEBUG', ts_ns, NULL, 'fn_name=' || service FROM env",
)
def calls(e: DataFrame) -> DataFrame:
    made = e.select("event_id", F.col("service").alias("fn_name"), F.col("ts_ns").alias("started_ns"), (F.col("ts_ns") + F.col("k")).alias("ended_ns"))
    return exports.call_events(made, entered=True).select("event_id", "full_name", "sev", "ts_ns", "latency_ns", labels_text(F.col("labels")).alias("labels"))


@event_query(
    "pj17_closed_spans",
    "SELECT event_id, 'obs.v1.ObsSpanCompleted' AS full_name, 'DEBUG' AS sev, ts_ns + k * 1000 AS ts_ns, k * 1000 AS latency_ns, 'name=' || event_type || ',target=' || service AS labels, trace_id FROM env WHERE k >= 10",
)
def closed(e: DataFrame) -> DataFrame:
    opened = e.select("event_id", "span_id", "trace_id", "ts_ns", F.col("labels")["event_type"].alias("name"), F.col("service").alias("target"))
    ends = e.where("k >= 10").select("span_id", (F.col("ts_ns") + F.col("k") * 1000).alias("closed_ns"))
    return exports.closed_spans(opened, ends).select("event_id", "full_name", "sev", "ts_ns", "latency_ns", labels_text(F.col("labels")).alias("labels"), "trace_id")


@query("sc08_spool_listing", ENV_SQL + "SELECT service || '-' || region AS batch, service || ':' || count(*) AS payload FROM env WHERE NOT (service = 'api' AND region = '2') GROUP BY service, region")
def spool_listing(spark: SparkSession, d: str) -> DataFrame:
    """Batches from a spool; the one whose file was cut off is left out."""
    at = shared_path(spark, "spool")
    n = env(spark, d).groupBy("service", F.col("labels")["region"].alias("region")).agg(F.count("*").alias("n"))
    text = spool.sealed(F.concat_ws(":", "service", F.col("n").cast("string")))
    broken = F.when((F.col("service") == "api") & (F.col("region") == "2"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(F.col("text"))
    n.select(F.concat_ws("-", "service", "region").alias("batch"), text.alias("text"), "service", "region").withColumn("text", broken).select("batch", "text").write.partitionBy("batch").text(at)
    return spool.listing(spark, at).select(F.regexp_extract("path", "/batch=([^/]*)/", 1).alias("batch"), "payload")
