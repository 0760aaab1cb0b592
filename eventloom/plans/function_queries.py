"""Queries of the scalar functions, of filters and of schema governance, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import filters
from eventloom.functions import text as tx
from eventloom.functions.envelope import CLASSES, KINDS, METRICS, labels_text, otlp_severity, tier_name
from eventloom.operators import dimensions, exports, governance, records, scopes
from eventloom.operators.scan import numbered
from eventloom.plans.event_queries import event_query, table
from eventloom.plans.registry import query
from eventloom.sinks import tables


def scalar(name: str, source: str, key: str, made, sql: str) -> None:
    """Register a query (key, out) of a scalar Column over a whole table."""
    query(name, f"SELECT {key}, {sql} AS out FROM {source}")(lambda spark, d: table(spark, d, source).select(key, made().alias("out")))


def _odd():
    """A text with digits first, quotes, a backslash, blanks and a line's end."""
    return F.concat(F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_type"), F.lit('-a"b\\'), F.col("p_name"), F.lit("\n"))


_ODD_SQL = "(p_partkey || ' ' || p_type || '-a\"b\\' || p_name || chr(10))"
_CLEAN = f"regexp_replace(regexp_replace({_ODD_SQL}, '[^A-Za-z0-9_:]', '_', 'g'), '^[0-9]', '_')"
_COUNTED = "regexp_replace(p_brand || CASE p_partkey % 4 WHEN 0 THEN '.count' WHEN 1 THEN '_counter' WHEN 2 THEN '_total' ELSE '' END, '[^A-Za-z0-9_:]', '_', 'g')"

scalar("fn05_metric_names", "part", "p_partkey", lambda: tx.metric_name(_odd()), _CLEAN)
scalar(
    "fn06_counter_names", "part", "p_partkey",
    lambda: tx.counter_name(F.concat("p_brand", F.when(F.col("p_partkey") % 4 == 0, ".count").when(F.col("p_partkey") % 4 == 1, "_counter").when(F.col("p_partkey") % 4 == 2, "_total").otherwise(""))),
    f"CASE WHEN ends_with({_COUNTED}, '_total') THEN {_COUNTED} ELSE regexp_replace({_COUNTED}, '_(count|counter)$', '') || '_total' END",
)
scalar("fn07_label_escapes", "part", "p_partkey", lambda: tx.label_escape(_odd()), f"replace(replace(replace({_ODD_SQL}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n')")
scalar(
    "fn08_float_texts", "customer", "c_custkey",
    lambda: tx.float_text(F.when(F.col("c_custkey") % 5 == 0, F.floor("c_acctbal").cast("double")).when(F.col("c_custkey") % 7 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))),
    "CASE WHEN c_custkey % 5 = 0 OR c_custkey % 77 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_acctbal = floor(c_acctbal) THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) WHEN c_custkey % 7 = 0 THEN '+Inf' WHEN c_custkey % 11 = 0 THEN 'NaN' ELSE CAST(c_acctbal AS VARCHAR) END",
)
scalar("fn10_short_texts", "documents", "doc_id", lambda: tx.short(F.col("text"), 512), "left(text, 512)")
scalar("fn11_snake_case", "part", "p_partkey", lambda: tx.snake_case(F.concat(F.initcap("p_type"), F.lit("Of"), "p_brand")), r"lower(regexp_replace(regexp_replace(array_to_string([upper(x[1]) || lower(x[2:]) FOR x IN string_split(p_type, ' ')], ' ') || 'Of' || p_brand, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'))")
scalar("fn13_status_classes", "part", "p_partkey", lambda: tx.status_class(F.col("p_partkey") % 701), "CASE WHEN p_partkey % 701 BETWEEN 100 AND 599 THEN (p_partkey % 701) // 100 || 'xx' ELSE 'err' END")
scalar("fn23_partition_names", "customer", "c_custkey", lambda: tx.partition_hex(F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string"))), "substr(sha256(c_mktsegment || '/' || c_nationkey), 1, 16)")
scalar(
    "fn24_hex_bytes", "orders", "o_orderkey",
    lambda: F.hex(tx.hex_bytes(F.when(F.col("o_orderkey") % 3 == 0, F.lower(F.hex("o_orderkey"))).when(F.col("o_orderkey") % 3 == 1, F.lit("zz")).otherwise(F.lit("AB")), 8)),
    "CASE WHEN o_orderkey % 3 = 0 AND length(hex(o_orderkey)) % 2 = 0 THEN rpad(hex(o_orderkey), 16, '0') WHEN o_orderkey % 3 = 2 THEN 'AB00000000000000' ELSE '0000000000000000' END",
)


@event_query("fn02_otlp_numbers", "SELECT event_id, CAST(CASE sev WHEN 'TRACE' THEN 1 WHEN 'DEBUG' THEN 5 WHEN 'INFO' THEN 9 WHEN 'WARN' THEN 13 WHEN 'ERROR' THEN 17 WHEN 'FATAL' THEN 21 END AS INTEGER) AS number FROM env")
def otlp_numbers(e: DataFrame) -> DataFrame:
    return e.select("event_id", otlp_severity(F.col("sev_rank")).alias("number"))


@event_query(
    "fn03_words",
    "SELECT event_id, tier, CASE event_id % 4 WHEN 0 THEN 'LABEL' WHEN 1 THEN 'TRACE_ID' WHEN 2 THEN 'MEASUREMENT' END AS kind, CASE event_id % 3 WHEN 0 THEN 'PII' WHEN 1 THEN 'SECRET' END AS class, CASE event_id % 2 WHEN 0 THEN 'GAUGE' END AS metric FROM env",
)
def words(e: DataFrame) -> DataFrame:
    pick = lambda *xs: F.get(F.array(*(F.lit(x) for x in xs)), (F.col("event_id") % len(xs)).cast("int"))
    return e.select(
        "event_id",
        tier_name(F.concat(F.lit(" tier_"), F.lower("tier"))).alias("tier"),
        tx.word_of(pick("label", "Trace_Id", " MEASUREMENT ", "labels"), KINDS).alias("kind"),
        tx.word_of(pick("pii", "Secret", "open"), CLASSES).alias("class"),
        tx.word_of(pick("metric_kind_gauge", "summary"), METRICS, "METRIC_KIND_").alias("metric"),
    )


_TARGETS = {"leaf": "shop.v1.ObsClick", "package": "shop.v1", "part": "shop.v", "module": "shop::web"}
_UNDER = ", ".join(f"name = '{t}' OR starts_with(name, '{t}.') OR starts_with(name, '{t}::') AS {c}" for c, t in _TARGETS.items())


@event_query("fn04_segments", f", named AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN full_name WHEN 1 THEN full_name || '.sub' WHEN 2 THEN full_name || 'Extra' WHEN 3 THEN 'shop::' || service ELSE 'shop::' || service || '::deep' END AS name FROM env) SELECT event_id, {_UNDER} FROM named")
def segments(e: DataFrame) -> DataFrame:
    """Whole segments only: ``shop.v1`` covers an event, ``shop.v`` does not."""
    module = F.concat(F.lit("shop::"), F.col("service"))
    forms = F.array(F.col("full_name"), F.concat("full_name", F.lit(".sub")), F.concat("full_name", F.lit("Extra")), module, F.concat(module, F.lit("::deep")))
    name = F.get(forms, (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", *(filters.under(name, t).alias(c) for c, t in _TARGETS.items()))


@event_query("fn12_payload_columns", "SELECT DISTINCT full_name, 'payload_' || lower(replace(full_name, '.', '_')) AS out FROM env")
def payload_columns(e: DataFrame) -> DataFrame:
    return e.select("full_name", tx.payload_column(F.col("full_name")).alias("out")).distinct()


@event_query("fn15_span_ids", "SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS fresh_trace, substr(md5(event_id || '/span'), 1, 16) AS fresh_span, trace_id AS child_trace, substr(md5(event_id || '/child/span'), 1, 16) AS child_span, span_id AS child_parent FROM env")
def span_ids(e: DataFrame) -> DataFrame:
    key = F.col("event_id").cast("string")
    fresh, child = tx.fresh_ids(key), tx.child_ids(F.col("trace_id"), F.col("span_id"), F.concat(key, F.lit("/child")))
    return e.select("event_id", fresh["trace_id"].alias("fresh_trace"), fresh["span_id"].alias("fresh_span"), child["trace_id"].alias("child_trace"), child["span_id"].alias("child_span"), child["parent_span_id"].alias("child_parent"))


@event_query("fn17_rfc3339", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at FROM env")
def rfc3339(e: DataFrame) -> DataFrame:
    return e.select("event_id", tx.rfc3339(F.col("ts_ns")).alias("at"))


@event_query("fn19_times_or_now", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN 1706659200000000000 ELSE ts_ns END AS ts_ns FROM env")
def times(e: DataFrame) -> DataFrame:
    odd = F.when(F.col("event_id") % 4 == 0, F.lit(0).cast("long")).when(F.col("event_id") % 4 > 1, F.col("ts_ns"))
    return e.select("event_id", tx.time_or_now(odd, 1706659200 * 10**9).alias("ts_ns"))


@event_query("fn25_redaction", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'User_Token=[REDACTED:bridge_pattern]' WHEN 1 THEN 'my-api-key-2=[REDACTED:bridge_pattern]' ELSE 'color=' || service END || ',region=' || region AS fields FROM env")
def redaction(e: DataFrame) -> DataFrame:
    name = F.when(F.col("event_id") % 3 == 0, "User_Token").when(F.col("event_id") % 3 == 1, "my-api-key-2").otherwise("color")
    return e.select("event_id", labels_text(tx.redact_map(F.create_map(name, F.col("service"), F.lit("region"), F.col("labels")["region"]))).alias("fields"))


@query("fn28_span_paths", "SELECT conv_id, string_agg(role, '.' ORDER BY turn, role) AS dotted, string_agg(role, ':' ORDER BY turn, role) AS coloned FROM conversations GROUP BY conv_id")
def span_paths(spark: SparkSession, d: str) -> DataFrame:
    frames = scopes.ancestry(table(spark, d, "conversations"), "conv_id", "turn", "role")
    names = F.split("span_path", ":")
    return frames.select("conv_id", tx.path_text(names, ".").alias("dotted"), tx.path_text(names, ":").alias("coloned"))


@event_query("fn31_quoted_fields", """SELECT event_id, 'a=' || service || ' b="x ' || service || '" c="" d="' || replace(replace(props, '\\', '\\\\'), '"', '\\"') || '"' AS fields, true AS has, region AS got FROM env""")
def quoted(e: DataFrame) -> DataFrame:
    made = F.create_map(F.lit("d"), F.col("props"), F.lit("b"), F.concat(F.lit("x "), "service"), F.lit("a"), F.col("service"), F.lit("c"), F.lit(""))
    return e.select("event_id", tx.quoted_fields(made).alias("fields"), F.map_contains_key("labels", "region").alias("has"), F.col("labels")["region"].alias("got"))


@event_query("fn32_json", """SELECT event_id, k, '{"props":' || to_json(props) || ',"n":' || k || '}' AS line FROM env""")
def json_round_trip(e: DataFrame) -> DataFrame:
    parsed = F.from_json("props", "k long")["k"]
    return e.select("event_id", parsed.alias("k"), F.to_json(F.struct("props", parsed.alias("n"))).alias("line"))


@event_query("fn33_resource_env", "SELECT event_id, service AS service_namespace, CASE event_id % 3 WHEN 0 THEN 'amd64' WHEN 1 THEN 'arm64' ELSE 'riscv64' END AS host_arch, 'k8s.pod.name=pod-' || event_id AS extra FROM env")
def resource_env(e: DataFrame) -> DataFrame:
    arch = F.when(F.col("event_id") % 3 == 0, "x86_64").when(F.col("event_id") % 3 == 1, "aarch64").otherwise("riscv64")
    given = F.concat(F.lit("service.namespace="), "service", F.lit(",host.arch="), arch, F.lit(",k8s.pod.name=pod-"), F.col("event_id").cast("string"))
    r = tx.resource_slots(given)
    return e.select("event_id", r["service_namespace"].alias("service_namespace"), r["host_arch"].alias("host_arch"), labels_text(r["extra"]).alias("extra"))


# Order, sets, maps.


@event_query("sl02_schema_order", "SELECT full_name, row_number() OVER (ORDER BY full_name) AS place FROM (SELECT DISTINCT full_name FROM env)")
def schema_order(e: DataFrame) -> DataFrame:
    """The model's columns stand in the order of their events' names."""
    names = e.agg(F.array_sort(F.collect_set("full_name")).alias("names"))  # one row an event type
    return names.select(F.posexplode("names").alias("place", "full_name")).select("full_name", (F.col("place") + 1).cast("long").alias("place"))


@event_query("sl03_sorted_labels", "SELECT event_id, labels_text AS labels, 'bucket' AS first FROM env")
def sorted_labels(e: DataFrame) -> DataFrame:
    return e.select("event_id", labels_text(F.col("labels")).alias("labels"), F.array_sort(F.map_keys("labels"))[0].alias("first"))


@event_query(
    "sl04_file_retention",
    """, files AS (SELECT service || '-' || k AS path, max(ts_ns) AS modified, CAST(round(sum(value)) AS BIGINT) AS bytes FROM env GROUP BY ALL),
    held AS (SELECT path, row_number() OVER w AS nth, sum(bytes) OVER w AS held FROM files WINDOW w AS (ORDER BY modified DESC, path DESC ROWS UNBOUNDED PRECEDING))
    SELECT path, CASE WHEN nth <= 20 THEN 'newest' ELSE '' END || CASE WHEN held > 5000 THEN 'evicted' ELSE '' END AS state FROM held""",
)
def retention(e: DataFrame) -> DataFrame:
    files = e.groupBy(F.concat_ws("-", "service", F.col("k").cast("string")).alias("path")).agg(F.max("ts_ns").alias("modified"), F.round(F.sum("value")).cast("long").alias("bytes"))
    new, gone = tables.newest(files, 20).select("path", F.lit("newest").alias("n")), tables.evicted(files, 5000).select("path", F.lit("evicted").alias("g"))
    return files.join(new, "path", "left").join(gone, "path", "left").select("path", F.concat(F.coalesce("n", F.lit("")), F.coalesce("g", F.lit(""))).alias("state"))


@event_query("sl05_series_order", "SELECT name, labels, row_number() OVER (ORDER BY name, labels) AS place, n FROM (SELECT lower(replace(full_name, '.', '_')) || '_total' AS name, labels_text AS labels, count(*) AS n FROM env GROUP BY ALL)")
def series_order(e: DataFrame) -> DataFrame:
    """Series as they are rendered: by name, then by labels."""
    series = e.groupBy(F.lower(tx.counter_name(F.col("full_name"))).alias("name"), labels_text(F.col("labels")).alias("labels")).agg(F.count("*").alias("n"))
    return numbered(series, [], ["name", "labels"], "place")


_SETS = "base AS (SELECT DISTINCT p_brand AS event FROM part WHERE p_size < 25 AND p_partkey % 3 > 0), head AS (SELECT DISTINCT p_brand AS event FROM part WHERE p_size >= 25 AND p_partkey % 5 > 1)"


@query("st02_schema_sets", f"WITH {_SETS} SELECT event, 'NEW' AS verdict FROM head WHERE event NOT IN (SELECT event FROM base) UNION ALL SELECT event, 'REMOVED' FROM base WHERE event NOT IN (SELECT event FROM head)")
def schema_sets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    base = p.where("p_size < 25 and p_partkey % 3 > 0").select(F.col("p_brand").alias("event")).distinct()
    head = p.where("p_size >= 25 and p_partkey % 5 > 1").select(F.col("p_brand").alias("event")).distinct()
    return head.join(base, "event", "left_anti").withColumn("verdict", F.lit("NEW")).unionByName(base.join(head, "event", "left_anti").withColumn("verdict", F.lit("REMOVED")))


@event_query("st03_map_union", "SELECT event_id, 'bucket=' || bucket || ',event.name=' || full_name || ',event_type=' || event_type || ',obs.sampling_reason=HEAD_RATE,region=' || region AS attributes FROM env")
def map_union(e: DataFrame) -> DataFrame:
    """A label with the name of an envelope's attribute gives way to it."""
    clash = e.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("event.name"), F.lit("mine"))))
    return records.log_record(clash).select("event_id", labels_text(F.col("attributes")).alias("attributes"))


@event_query("st04_unique_labels", "SELECT event_id, 'a=' || least(service, region) || ',b=' || event_type AS labels FROM env")
def unique(e: DataFrame) -> DataFrame:
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    return e.select("event_id", labels_text(tx.unique_labels(F.array(pair("b", F.col("labels")["event_type"]), pair("a", F.col("service")), pair("a", F.col("labels")["region"])))).alias("labels"))


# Filters.


@event_query("fl11_subscriber_match", "SELECT event_id FROM env WHERE region = '2' AND event_type = 'error' AND sev_rank >= 6")
def subscriber_match(e: DataFrame) -> DataFrame:
    return dimensions.subscribed(e, [dict(name="one", sev_rank=6, labels={"region": "2", "event_type": "error"})]).select("event_id")


@event_query("fl12_sink_floors", "SELECT sink, count(*) AS n FROM env, (VALUES ('stdout', 3), ('file', 1), ('page', 6)) s(sink, least) WHERE sev_rank >= least GROUP BY sink")
def sink_floors(e: DataFrame) -> DataFrame:
    floors = {"stdout": "info", "file": "trace", "page": "fatal"}
    hits = F.array_compact(F.array(*(F.when(F.col("sev_rank") >= filters.level(least), F.lit(sink)) for sink, least in floors.items())))
    return e.select(F.explode(hits).alias("sink")).groupBy("sink").agg(F.count("*").alias("n"))


@event_query("fl20_loop_guard", "SELECT event_id, CASE event_id % 4 WHEN 1 THEN 'app' WHEN 2 THEN 'obs.bri' ELSE 'obs' END AS target FROM env WHERE event_id % 4 > 0")
def loop_guard(e: DataFrame) -> DataFrame:
    target = F.get(F.array(*(F.lit(x) for x in ("obs.bridge.self", "app", "obs.bri", "obs"))), (F.col("event_id") % 4).cast("int"))
    return records.bridged(e.select("event_id", target.alias("target"), F.create_map(F.lit("message"), F.lit("m")).alias("fields")), []).select("event_id", "target")


@event_query("fl22_finding_filter", "SELECT event_id, full_name AS event FROM env WHERE contains(full_name, 'Cli') OR contains(full_name, 'Err')")
def finding_filter(e: DataFrame) -> DataFrame:
    return governance.named(e.select("event_id", F.col("full_name").alias("event")), ["Cli", "Err"])


# Schemas. The parts table stands in for a large registry: a brand is an event, a size a field of it.

_FIELD = "['LABEL', 'ATTRIBUTE', 'MEASUREMENT'][pk % 3 + 1] AS kind, ['LOW', 'MEDIUM', 'HIGH', 'UNBOUNDED'][pk % 4 + 1] AS cardinality, ['INTERNAL', 'PII', 'SECRET'][pk % 5 % 3 + 1] AS class"
_SIDE = "SELECT event, tag, pk, " + _FIELD + " FROM (SELECT p_brand AS event, p_size AS tag, {0}(p_partkey) AS pk FROM part WHERE p_partkey % 7 {1} GROUP BY ALL)"
_DIFFED = f"""WITH b AS ({_SIDE.format("min", "> 1")}), h AS ({_SIDE.format("max", "< 5")}), eb AS (SELECT DISTINCT event FROM b), eh AS (SELECT DISTINCT event FROM h),
j AS (SELECT coalesce(b.event, h.event) AS event, coalesce(b.tag, h.tag) AS tag, b.event IS NULL AS added, h.event IS NULL AS removed, b.kind AS bk, h.kind AS hk, b.cardinality AS bc, h.cardinality AS hc, b.class AS bl, h.class AS hl
  FROM b FULL JOIN h ON b.event = h.event AND b.tag = h.tag WHERE coalesce(b.event, h.event) IN (SELECT event FROM eb INTERSECT SELECT event FROM eh)),
r AS (SELECT *, list_position(['LOW', 'MEDIUM', 'HIGH', 'UNBOUNDED'], bc) AS rb, list_position(['LOW', 'MEDIUM', 'HIGH', 'UNBOUNDED'], hc) AS rh, list_position(['INTERNAL', 'PII', 'SECRET'], bl) AS lb, list_position(['INTERNAL', 'PII', 'SECRET'], hl) AS lh FROM j),
d AS (SELECT event, tag, CASE WHEN removed THEN 'field removed' WHEN added THEN 'field added' WHEN bk <> hk THEN 'kind' WHEN bc <> hc THEN 'cardinality' WHEN bl <> hl THEN 'class' END AS change,
  CASE WHEN removed THEN 'BREAKING' WHEN added THEN 'OK' WHEN bk <> hk THEN 'BREAKING' WHEN bc <> hc THEN CASE WHEN rh > rb THEN 'BREAKING' ELSE 'OK' END WHEN lh < lb THEN 'BREAKING' ELSE 'OK' END AS verdict FROM r),
changes AS (SELECT event, CAST(tag AS INTEGER) AS tag, change, verdict FROM d WHERE change IS NOT NULL UNION ALL SELECT event, NULL, 'event added', 'NEW' FROM eh WHERE event NOT IN (SELECT event FROM eb)
  UNION ALL SELECT event, NULL, 'event removed', 'BREAKING' FROM eb WHERE event NOT IN (SELECT event FROM eh)) """


def _registry(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, d, "part")

    def side(where: str, pick) -> DataFrame:
        pk = pick("p_partkey")
        rows = p.where(where).groupBy(F.col("p_brand").alias("event"), F.col("p_size").alias("tag")).agg(pk.alias("pk"))
        of = lambda by, *xs: F.get(F.array(*(F.lit(x) for x in xs)), by.cast("int"))
        k = F.col("pk")
        return rows.select("event", "tag", "pk", of(k % 3, "LABEL", "ATTRIBUTE", "MEASUREMENT").alias("kind"), of(k % 4, "LOW", "MEDIUM", "HIGH", "UNBOUNDED").alias("cardinality"), of(k % 5 % 3, "INTERNAL", "PII", "SECRET").alias("class"))

    return side("p_partkey % 7 > 1", F.min), side("p_partkey % 7 < 5", F.max)


@query("gv06_breaking_changes", _DIFFED + "SELECT event, tag, change, verdict FROM changes")
def breaking(spark: SparkSession, d: str) -> DataFrame:
    return governance.diff(*_registry(spark, d))


@query("ag13_diff_tallies", _DIFFED + "SELECT verdict, count(*) AS n FROM changes GROUP BY verdict")
def diff_tallies(spark: SparkSession, d: str) -> DataFrame:
    return governance.tallies(governance.diff(*_registry(spark, d)))


@query("jn07_label_conflicts", f"WITH b AS ({_SIDE.format('min', '> 1')}) SELECT 'field_' || tag AS field, count(DISTINCT cardinality || class) AS n_signatures FROM b WHERE kind = 'LABEL' GROUP BY tag HAVING count(DISTINCT cardinality || class) > 1")
def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    fields = _registry(spark, d)[0].withColumns({"field": F.concat(F.lit("field_"), F.col("tag").cast("string")), "type": F.lit("string")})
    return governance.label_conflicts(fields)


@query("jn08_hash_collisions", "WITH s AS (SELECT p_brand AS name, sum(p_size) % 16 AS h FROM part GROUP BY p_brand) SELECT CAST(a.h AS BIGINT) AS schema_hash, a.name AS first_event, b.name AS second_event FROM s a JOIN s b ON a.h = b.h AND a.name < b.name")
def hash_collisions(spark: SparkSession, d: str) -> DataFrame:
    hashed = table(spark, d, "part").groupBy(F.col("p_brand").alias("full_name")).agg((F.sum("p_size") % 16).alias("schema_hash"))
    return governance.hash_collisions(hashed)


@event_query(
    "gv03_site_budget",
    """, notes AS (SELECT region || '.rs' AS site, region, k FROM env WHERE event_id % 7 = 0), used AS (SELECT site, region, count(*) AS n, CAST(sum(CASE WHEN k > 90 THEN 1 ELSE 0 END) AS BIGINT) AS n_waived FROM notes GROUP BY ALL)
    SELECT site, n, n_waived, CASE WHEN region = '0' THEN 1000000 ELSE 5 END AS budget FROM used WHERE n - n_waived > CASE WHEN region = '0' THEN 1000000 ELSE 5 END""",
)
def site_budget(e: DataFrame) -> DataFrame:
    """Sites with more free-form events than their budget: five, or the site's own; waived ones don't count."""
    notes = e.where("event_id % 7 = 0").select(F.concat(F.col("labels")["region"], F.lit(".rs")).alias("site"), F.col("props").alias("message"), F.create_map(F.lit("waived"), (F.col("k") > 90).cast("string")).alias("attrs"))
    own = e.sparkSession.createDataFrame([("0.rs", 1_000_000)], "site string, budget int")
    return governance.over_budget(exports.forensic_events(notes), own, 5).select("site", "n", "n_waived", "budget")


@query("gv04_enum_variants", "WITH e AS (SELECT p_brand AS event, p_type AS field, count(*) AS variants, CASE WHEN min(p_partkey) % 2 = 0 THEN 2 ELSE 5 END AS cap FROM part GROUP BY ALL) SELECT event, field, 'L005' AS rule FROM e WHERE variants > cap")
def enum_variants(spark: SparkSession, d: str) -> DataFrame:
    """Labels whose enumeration has more values than their cardinality allows."""
    counted = table(spark, d, "part").groupBy(F.col("p_brand").alias("event"), F.col("p_type").alias("field")).agg(F.count("*").cast("int").alias("variants"), F.min("p_partkey").alias("pk"))
    own = {"kind": "LABEL", "class": "INTERNAL", "metric": None, "type": "enum", "tier": "LOG"}
    fields = counted.withColumns({**{k: F.lit(v).cast("string") for k, v in own.items()}, "tag": F.lit(1), "cardinality": F.when(F.col("pk") % 2 == 0, "LOW").otherwise("MEDIUM")})
    return governance.lint(fields, prefix="", caps={"LOW": 2, "MEDIUM": 5}).where("rule = 'L005'")


@event_query("ag14_callsite_registrations", ", c AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY ts_ns, event_id) AS nth, min(ts_ns) OVER (PARTITION BY service) AS first_ns FROM env) SELECT event_id, service FROM c WHERE (nth - 1) % 50 = 0 AND ts_ns - first_ns < 864000000000000 OR ts_ns - first_ns >= 864000000000000")
def registrations(e: DataFrame) -> DataFrame:
    return dimensions.registrations(e, "service", "ts_ns", "event_id", every=50, after_ns=10 * 86400 * 10**9).select("event_id", "service")


@event_query("ag16_schema_dictionary", "SELECT string_agg(substr(md5(full_name), 1, 16) || '=' || full_name, ',' ORDER BY substr(md5(full_name), 1, 16)) AS dictionary FROM (SELECT DISTINCT full_name FROM env)")
def dictionary(e: DataFrame) -> DataFrame:
    """The names that a batch's hashes stand for (one entry an event type)."""
    entry = F.struct(F.substring(F.md5("full_name"), 1, 16).alias("key"), F.col("full_name").alias("value"))
    return e.agg(labels_text(F.map_from_entries(F.collect_set(entry))).alias("dictionary"))


@event_query("jn10_event_dispatch", "SELECT event_id, CASE WHEN event_type = 'click' THEN k END AS click_k, CASE WHEN event_type = 'error' THEN value END AS error_value, event_type IN ('click', 'error') AS typed FROM env")
def dispatch(e: DataFrame) -> DataFrame:
    made = exports.dispatched(e, {"shop.v1.ObsClick": ["k"], "shop.v1.ObsError": ["value", "props"]})
    click, error = F.col("payload_shop_v1_obsclick"), F.col("payload_shop_v1_obserror")
    return made.select("event_id", click["k"].alias("click_k"), error["value"].alias("error_value"), (click.isNotNull() | error.isNotNull()).alias("typed"))
