"""Queries over other tables, stored forms and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.functions import wire
from eventloom.functions.envelope import ENV_SQL, TIERS, labels_text
from eventloom.operators import sampling, scopes
from eventloom.plans.event_queries import env, table
from eventloom.plans.registry import query
from eventloom.plans.storage import drained, shared_path
from eventloom.sources import ndjson
from eventloom.sinks import tables
from eventloom.streaming import stateful


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes as JSON lines, among them a blank, a malformed and a foreign one in ten each."""
    e = env(spark, d)
    line = F.to_json(F.struct("ts_ns", "full_name", "sev", "tier", "service", "trace_id", "span_id", "labels", F.col("props").alias("payload")))
    kind = F.col("event_id") % 10
    return e.select(F.when(kind == 0, "  ").when(kind == 1, "{bad").when(kind == 2, '{"other": 1}').otherwise(line).alias("value"))


_SCANNED = ENV_SQL + "SELECT ts_ns, full_name, sev, span_id, labels_text AS labels, props AS payload FROM env WHERE event_id % 10 > 2"


def _scanned(rows: DataFrame) -> DataFrame:
    return rows.select("ts_ns", "full_name", "sev", "span_id", labels_text(F.col("labels")).alias("labels"), "payload")


@query("sc01_ndjson_scan", _SCANNED)
def ndjson_scan(spark: SparkSession, d: str) -> DataFrame:
    return _scanned(ndjson.parse(_lines(spark, d)))


@query("sc02_ndjson_follow", _SCANNED)
def ndjson_follow(spark: SparkSession, d: str) -> DataFrame:
    at = shared_path(spark, "lines")
    _lines(spark, d).write.text(at)
    return _scanned(drained(ndjson.follow(spark, at), "followed"))


@query("sk10_ndjson_round_trip", _SCANNED)
def ndjson_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = shared_path(spark, "ndjson")
    _lines(spark, d).write.option("compression", "gzip").text(at)
    return _scanned(ndjson.scan(spark, at))


_WIRED = ENV_SQL + "SELECT full_name, ts_ns, trace_id, span_id, service, tier, labels_text AS labels, props AS payload FROM env"


def _through_wire(spark: SparkSession, d: str, form: str) -> DataFrame:
    e = env(spark, d)
    number = F.array_position(F.array(*(F.lit(t) for t in TIERS)), F.col("tier"))
    frames = wire.encoded(e.withColumns({"tier": number, "sev": F.col("sev_rank").cast("long"), "payload": F.encode("props", "UTF-8")}), ["event_id"])
    if form == "envelope":
        blobs = frames.select("frame")
    else:
        grouped = frames.groupBy(F.floor(F.col("event_id") / 200).alias("file")).agg(F.collect_list("frame").alias("parts"))  # 200 a file, by the id

        def join(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([wire.joined(x, form) for x in b.column(0).to_pylist()], pa.binary())], names=["frame"])

        blobs = grouped.select("parts").mapInArrow(join, "frame binary")
    found = wire.decoded(blobs, "frame", form)
    name = F.get(F.array(*(F.lit(t) for t in TIERS)), (F.col("tier") - 1).cast("int"))
    return found.select("full_name", "ts_ns", "trace_id", "span_id", "service", name.alias("tier"), labels_text(F.col("labels")).alias("labels"), F.decode("payload", "UTF-8").alias("payload"))


for _name, _form in (("fn27_wire_decode", "envelope"), ("sc05_batch_decode", "batch"), ("sc06_spool_scan", "records"), ("sc07_framed_scan", "frames")):
    query(_name, _WIRED)(lambda spark, d, f=_form: _through_wire(spark, d, f))


@query(
    "sk01_parquet_table",
    ENV_SQL + "SELECT service, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM env WHERE service = 'web' AND CAST(ts AS DATE) >= DATE '2024-01-15' GROUP BY ALL",
)
def parquet_table(spark: SparkSession, d: str) -> DataFrame:
    at = shared_path(spark, "events")
    tables.write(env(spark, d), at)
    found = tables.read(spark, at).withColumn("date", F.col("date").cast("string"))
    return found.where("service = 'web' and date >= '2024-01-15'").groupBy("service", "date").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("sk06_table_per_event", ENV_SQL + "SELECT full_name, count(*) AS n FROM env GROUP BY full_name")
def per_event(spark: SparkSession, d: str) -> DataFrame:
    at = shared_path(spark, "by-event")
    tables.write(env(spark, d), at, by=("full_name",))
    return tables.read(spark, at).groupBy("full_name").agg(F.count("*").alias("n"))


@query(
    "pj06_typed_payload",
    ENV_SQL + "SELECT event_id, CASE WHEN event_type = 'purchase' THEN k END AS k, CASE WHEN event_type = 'purchase' THEN '<redacted>' END AS props, CAST(NULL AS BIGINT) AS user_id FROM env",
)
def typed(spark: SparkSession, d: str) -> DataFrame:
    made = tables.typed_payload(env(spark, d), "shop.v1.ObsPurchase", {"k": "INTERNAL", "props": "PII", "user_id": "PII"})
    c = "payload_shop_v1_obspurchase"
    return made.select("event_id", f"{c}.k", f"{c}.props", f"{c}.user_id")


@query("sk21_idempotent_batches", ENV_SQL + "SELECT event_id, full_name FROM env")
def idempotent(spark: SparkSession, d: str) -> DataFrame:
    source, out = shared_path(spark, "in"), shared_path(spark, "out")
    env(spark, d).select("event_id", "full_name").write.parquet(source)
    stream = spark.readStream.schema("event_id long, full_name string").option("maxFilesPerTrigger", 2).parquet(source)
    put = tables.put_batch(out)
    q = stream.writeStream.foreachBatch(tables.fan_out([put, put])).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id long, full_name string").parquet(out).select("event_id", "full_name")


@query("sr08_stream_pairs", ENV_SQL + " SELECT span_id, ts_ns AS start_ns, ts_ns + 5000000000 AS end_ns FROM env WHERE ('0x' || substr(span_id, 1, 1))::BIGINT < 8")
def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    at = shared_path(spark, "halves")
    e = env(spark, d).select("span_id", "ts_ns")
    ends = e.where("conv(substr(span_id, 1, 1), 16, 10) < 8").withColumn("ts_ns", F.col("ts_ns") + 5 * 10**9)
    e.withColumn("half", F.lit("s")).unionByName(ends.withColumn("half", F.lit("e"))).write.partitionBy("half").parquet(at)
    read = lambda h: spark.readStream.schema("span_id string, ts_ns long").parquet(f"{at}/half={h}")
    found = drained(stateful.pairs(read("s"), read("e")).select("started_key", "start_ns", "end_ns"), "pairs")
    return found.where("end_ns is not null").select(F.col("started_key").alias("span_id"), "start_ns", "end_ns")


@query("st05_stream_dedup", ENV_SQL + "SELECT DISTINCT ts_ns, full_name, trace_id FROM env")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    at = shared_path(spark, "replayed")
    e = env(spark, d).select("ts_ns", "full_name", "trace_id")
    e.unionByName(e).write.parquet(at)
    keys = ["ts_ns", "full_name", "trace_id"]
    stream = spark.readStream.schema("ts_ns long, full_name string, trace_id string").parquet(at)
    return drained(stateful.deduplicated(stream, keys, "60 days").select(*keys), "unique")


@query(
    "fn09_capped_texts",
    """SELECT doc_id, octet_length(encode(text)) > 256 AS was_cut, CASE WHEN octet_length(encode(text)) <= 256 THEN text ELSE
    (SELECT max(left(text, n)) FROM range(0, 257) r(n) WHERE octet_length(encode(left(text, n))) <= 256 AND n = (SELECT max(m) FROM range(0, 257) q(m) WHERE octet_length(encode(left(text, m))) <= 256)) || '…<truncated:' || octet_length(encode(text)) || '>' END AS text FROM documents""",
)
def capped(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select("doc_id", (F.octet_length("text") > 256).alias("was_cut"), tx.cap_bytes(F.col("text"), 256).alias("text"))


@query(
    "fl13_fl14_size_caps",
    "SELECT doc_id, CASE WHEN octet_length(encode(text)) > 4096 THEN 'PAYLOAD' WHEN octet_length(encode(left(text, 600))) > 620 THEN 'LABEL' END AS broken FROM documents",
)
def caps(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    labels = F.create_map(F.lit("lang"), F.col("lang"), F.lit("head"), F.left("text", F.lit(600)))
    return docs.select("doc_id", sampling.within_caps(F.col("text"), labels, 4096, 620).alias("broken"))


_FRAMES = "WITH frames AS (SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN role END AS who, CASE WHEN turn % 2 = 1 THEN turn % 4 < 2 END AS sampled FROM conversations)"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.when(t % 3 == 0, F.col("role")).alias("who"), F.when(t % 2 == 1, t % 4 < 2).alias("sampled"))


@query(
    "pj04_scope_fill",
    _FRAMES + ", s AS (SELECT conv_id, arg_max(who, turn) FILTER (WHERE who IS NOT NULL) AS who FROM frames GROUP BY conv_id) SELECT f.conv_id, f.turn, CASE WHEN f.turn % 2 = 0 THEN 'set' ELSE coalesce(s.who, '') END AS who FROM frames f JOIN s USING (conv_id)",
)
def scope_fill(spark: SparkSession, d: str) -> DataFrame:
    f = _frames(spark, d)
    inner = scopes.innermost(f, "conv_id", "turn", ["who"])
    own = F.map_filter(F.create_map(F.lit("who"), F.when(F.col("turn") % 2 == 0, "set")), lambda k, v: v.isNotNull())
    filled = scopes.fill(f.select("conv_id", "turn", own.alias("labels")), inner, "conv_id", ["who"])
    return filled.select("conv_id", "turn", F.coalesce(F.col("labels")["who"], F.lit("")).alias("who"))


@query(
    "wn06_outer_sampled",
    _FRAMES + "SELECT conv_id, arg_min(sampled, turn) FILTER (WHERE sampled IS NOT NULL) AS sampled FROM frames GROUP BY conv_id",
)
def outer_sampled(spark: SparkSession, d: str) -> DataFrame:
    return scopes.outermost(_frames(spark, d), "conv_id", "turn", "sampled")


@query("wn07_inner_correlation", _FRAMES + "SELECT conv_id, arg_max(who, turn) FILTER (WHERE who IS NOT NULL) AS who, arg_max(role, turn) AS role FROM frames GROUP BY conv_id")
def inner_correlation(spark: SparkSession, d: str) -> DataFrame:
    return scopes.innermost(_frames(spark, d), "conv_id", "turn", ["who", "role"])


@query("pj23_span_path", "SELECT conv_id, string_agg(role, ':' ORDER BY turn, role) AS span_path FROM conversations GROUP BY conv_id")
def span_path(spark: SparkSession, d: str) -> DataFrame:
    return scopes.ancestry(table(spark, d, "conversations"), "conv_id", "turn", "role")


@query(
    "pj19_http_events",
    """SELECT page_id, CASE WHEN (page_id % 7) * 100 BETWEEN 100 AND 599 THEN CAST(page_id % 7 AS VARCHAR) || 'xx' ELSE 'err' END AS status_class, CASE page_id % 2 WHEN 0 THEN 'shop.v1.ObsHttpRequestCompleted' ELSE 'shop.v1.ObsHttpClientCompleted' END AS full_name,
    regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1) AS route FROM pages""",
)
def http_events(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("page_id") % 2 == 0, "shop.v1.ObsHttpRequestCompleted").otherwise("shop.v1.ObsHttpClientCompleted")
    route = F.regexp_extract("url", "^[a-z]+://[^/]*(/[^?#]*)?", 1)
    return table(spark, d, "pages").select("page_id", tx.status_class((F.col("page_id") % 7) * 100).alias("status_class"), name.alias("full_name"), route.alias("route"))


@query(
    "jn05_order_revenue",
    """SELECT n_name AS nation, r_name AS region, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
)
def order_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Order events with the resource attributes of their customer's nation and region."""
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    who = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    found = table(spark, d, "orders").select("o_custkey", "o_totalprice").join(who, F.col("o_custkey") == F.col("c_custkey"))
    return found.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "jn03_order_shipments",
    """SELECT o_orderkey, count(l_orderkey) AS n_lines, min(epoch_us(l_shipdate) - epoch_us(o_orderdate)) * 1000 AS first_ns FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate GROUP BY o_orderkey""",
)
def shipments(spark: SparkSession, d: str) -> DataFrame:
    """Placed orders with their shipped lines: pairing on one shared key, one shuffle a side."""
    from eventloom.functions.envelope import nanos

    o = table(spark, d, "orders").select("o_orderkey", nanos(F.col("o_orderdate")).alias("placed"))
    s = table(spark, d, "lineitem").select("l_orderkey", nanos(F.col("l_shipdate")).alias("shipped"))
    joined = o.join(s, (o.o_orderkey == s.l_orderkey) & (s.shipped >= o.placed), "left")
    return joined.groupBy("o_orderkey").agg(F.count("l_orderkey").alias("n_lines"), F.min(F.col("shipped") - F.col("placed")).alias("first_ns"))
