"""Queries over the envelopes that the ``events`` table becomes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import filters
from eventloom.functions import text as tx
from eventloom.functions.envelope import ENV_SQL, from_events, labels_text, sev_rank, severity_name
from eventloom.operators import dimensions, limits, metrics, records, sampling, scan, scopes, spans
from eventloom.plans.registry import query
from eventloom.sources import ndjson

FLAGSHIP_FILTER = "info,shop.v1.ObsClick=debug,shop.v1.ObsSignup=off"
BOUNDS = [10.0, 50.0, 100.0, 250.0, 500.0]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def env(spark: SparkSession, d: str) -> DataFrame:
    return from_events(table(spark, d, "events"))


def rounded(c: str, digits: int = 4):
    return F.round(c, digits)


def query_of_env(name: str, sql: str):
    """Register a function of the envelopes with its whole SQL."""

    def add(f):
        query(name, sql)(lambda spark, d: f(env(spark, d)))
        return f

    return add


def event_query(name: str, sql: str):
    """Register a function of the envelopes; ``sql`` goes on after the WITH clause of ``env``."""
    return query_of_env(name, ENV_SQL + sql)


IDS = ["event_id", "full_name", "sev"]


@event_query(
    "m0_filtered_volume",
    """SELECT full_name, sev, count(*) AS n, round(sum(value), 4) AS total, max(ts_ns) AS last_ns FROM env
    WHERE CASE WHEN full_name = 'shop.v1.ObsSignup' THEN false WHEN full_name = 'shop.v1.ObsClick' THEN sev_rank >= 2 ELSE sev_rank >= 3 END GROUP BY ALL""",
)
def filtered_volume(e: DataFrame) -> DataFrame:
    return e.where(filters.allowed(FLAGSHIP_FILTER)).groupBy("full_name", "sev").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("ts_ns").alias("last_ns"))


@event_query("pj01_envelope", "SELECT event_id, full_name, tier, sev, sev_rank, ts_ns, trace_id, span_id, service, labels_text AS labels, 'HEAD_RATE' AS sampling_reason FROM env")
def envelope(e: DataFrame) -> DataFrame:
    return e.select("event_id", "full_name", "tier", "sev", "sev_rank", "ts_ns", "trace_id", "span_id", "service", labels_text(F.col("labels")).alias("labels"), "sampling_reason")


_FILTERS = {
    "fl02_longest_static": ("warn,shop=info,shop.v1.ObsClick=off,shop.v1=error", "CASE WHEN full_name = 'shop.v1.ObsClick' THEN false ELSE sev_rank >= 5 END"),
    "fl03_label_directives": (
        "warn,shop.v1.ObsClick[region=1]=debug,shop.v1.ObsClick[region=2,bucket=3]=trace,shop.v1.ObsError[region=4]=off",
        "CASE WHEN full_name = 'shop.v1.ObsClick' AND region = '1' THEN sev_rank >= 2 WHEN full_name = 'shop.v1.ObsClick' AND region = '2' AND bucket = '3' THEN true WHEN full_name = 'shop.v1.ObsError' AND region = '4' THEN false ELSE sev_rank >= 4 END",
    ),
    "fl04_default_floor": ("error", "sev_rank >= 5"),
    "fl04_default_off": ("off,shop.v1.ObsPurchase", "full_name = 'shop.v1.ObsPurchase'"),
}
for _name, (_text, _where) in _FILTERS.items():
    event_query(_name, f"SELECT event_id, full_name, sev FROM env WHERE {_where}")(lambda e, t=_text: e.where(filters.allowed(t)).select(*IDS))


@event_query(
    "fl05_interest",
    "SELECT full_name, CASE WHEN full_name = 'shop.v1.ObsClick' THEN 'SOMETIMES' WHEN min(sev_rank) >= 3 THEN 'ALWAYS' ELSE 'NEVER' END AS interest FROM env GROUP BY full_name",
)
def interest(e: DataFrame) -> DataFrame:
    schemas = e.groupBy("full_name").agg(F.min("sev_rank").alias("default_rank"))
    return filters.interest(schemas, "info,shop.v1.ObsClick[region=1]=debug").select("full_name", "interest")


_NOW = 1706745600 * 10**9
_QUERIES = {
    "fl06_event_names": (dict(events=["shop.v1.ObsClick", "shop.v1.ObsView"]), "full_name IN ('shop.v1.ObsClick', 'shop.v1.ObsView')"),
    "fl07_min_severity": (dict(severity="warning"), "sev_rank >= 4"),
    "fl08_labels": (dict(labels={"region": "3", "event_type": "error"}), "region = '3' AND event_type = 'error'"),
    "fl09_since": (dict(since="10d", now_ns=_NOW), f"ts_ns >= {_NOW - 10 * 86400 * 10**9}"),
    "fl21_until_trace_grep": (dict(until_ns=_NOW - 15 * 86400 * 10**9, grep=("props", "7")), f"ts_ns < {_NOW - 15 * 86400 * 10**9} AND contains(props, '7')"),
    "jn11_trace_stitching": (dict(trace="%"), None),
}
for _name, (_args, _where) in _QUERIES.items():
    if _where:
        event_query(_name, f"SELECT event_id, full_name, sev FROM env WHERE {_where}")(lambda e, a=_args: ndjson.query(e, **a).select(*IDS))


@event_query(
    "jn11_trace_stitching",
    "SELECT trace_id, count(*) AS n, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, CAST(sum(CASE WHEN sev_rank >= 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM env GROUP BY trace_id",
)
def traces(e: DataFrame) -> DataFrame:
    return e.groupBy("trace_id").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count_if(F.col("sev_rank") >= 5).alias("n_errors"))


@event_query("sl01_limit", "SELECT event_id, full_name, sev FROM env WHERE sev_rank >= 5 ORDER BY ts_ns, event_id LIMIT 100")
def limited(e: DataFrame) -> DataFrame:
    return ndjson.query(e, severity="error", order_by=["ts_ns", "event_id"], limit=100, select=IDS)


@event_query("sl06_order_by_select", "SELECT event_id, service, value FROM env WHERE service = 'web' ORDER BY value DESC, event_id LIMIT 50")
def ordered(e: DataFrame) -> DataFrame:
    return ndjson.query(e.where("service = 'web'"), order_by=["-value", "event_id"], limit=50, select=["event_id", "service", "value"])


@event_query("fl10_tail_filter", "SELECT event_id, full_name, sev FROM env WHERE event_id % 10 = 0 OR sev_rank >= 4")
def tail_filter(e: DataFrame) -> DataFrame:
    foreign = e.withColumn("seen", F.when(F.col("event_id") % 10 != 0, F.col("full_name")))
    return foreign.where(F.col("seen").isNull() | filters.allowed("warn", name="seen")).select(*IDS)


_SUBSCRIBERS = [dict(name="errors", sev_rank=5, labels={}), dict(name="region1", sev_rank=1, labels={"region": "1"}), dict(name="clicks", sev_rank=2, labels={"event_type": "click", "region": "2"})]
_SUBSCRIBED = """, hits AS (SELECT 'errors' AS subscriber, * FROM env WHERE sev_rank >= 5 UNION ALL SELECT 'region1', * FROM env WHERE region = '1'
    UNION ALL SELECT 'clicks', * FROM env WHERE sev_rank >= 2 AND event_type = 'click' AND region = '2')"""


@event_query("jn12_subscribers", _SUBSCRIBED + "SELECT subscriber, event_id FROM hits")
def subscribers(e: DataFrame) -> DataFrame:
    return dimensions.subscribed(e, _SUBSCRIBERS).select("subscriber", "event_id")


@event_query("ag10_subscriber_counts", _SUBSCRIBED + "SELECT subscriber, least(count(*), 500) AS delivered, greatest(count(*) - 500, 0) AS dropped FROM hits GROUP BY subscriber")
def subscriber_counts(e: DataFrame) -> DataFrame:
    n = F.count("*")
    return dimensions.subscribed(e, _SUBSCRIBERS).groupBy("subscriber").agg(F.least(n, F.lit(500)).alias("delivered"), F.greatest(n - 500, F.lit(0)).alias("dropped"))


_UNIT = "CAST(('0x' || substr(md5(trace_id), 1, 8)) AS BIGINT) / 4294967296.0"


@event_query(
    "fl15_head_sampler",
    f"SELECT event_id, full_name, CASE WHEN tier = 'AUDIT' THEN 'AUDIT' ELSE 'HEAD_RATE' END AS sampling_reason FROM env WHERE tier = 'AUDIT' OR sev_rank >= 4 OR {_UNIT} < CASE WHEN full_name = 'shop.v1.ObsClick' THEN 0.5 ELSE 0.1 END",
)
def head_sampler(e: DataFrame) -> DataFrame:
    return sampling.sampled(e, sampling.head_decision(0.1, {"shop.v1.ObsClick": 0.5})).select("event_id", "full_name", "sampling_reason")


@event_query(
    "fl16_parent_decision",
    f"""SELECT event_id, CASE WHEN tier = 'AUDIT' THEN 'AUDIT' WHEN user_id % 4 = 0 THEN 'OVERRIDE' ELSE 'HEAD_RATE' END AS sampling_reason FROM env
    WHERE tier = 'AUDIT' OR CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE sev_rank >= 4 OR {_UNIT} < 0.2 END""",
)
def parent_decision(e: DataFrame) -> DataFrame:
    inbound = F.when(F.col("user_id") % 4 == 0, True).when(F.col("user_id") % 4 == 1, False)
    return sampling.sampled(e, sampling.head_decision(0.2, inbound=inbound), inbound).select("event_id", "sampling_reason")


@event_query("fl17_forced_reasons", "SELECT event_id, CASE WHEN tier = 'AUDIT' THEN 'AUDIT' ELSE 'FORENSIC' END AS sampling_reason FROM env WHERE tier = 'AUDIT' OR event_id % 7 = 0")
def forced(e: DataFrame) -> DataFrame:
    marked = e.withColumn("sampling_reason", F.when(F.col("event_id") % 7 == 0, "FORENSIC").otherwise(F.col("sampling_reason")))
    return sampling.sampled(marked, F.lit(False)).select("event_id", "sampling_reason")


@event_query("fl18_tier_router", "SELECT event_id, CASE tier WHEN 'METRIC' THEN 'prom' WHEN 'TRACE' THEN 'otlp' WHEN 'AUDIT' THEN NULL ELSE 'parquet' END AS sink FROM env")
def router(e: DataFrame) -> DataFrame:
    return sampling.route(e, {"METRIC": "prom", "TRACE": "otlp"}, "parquet").select("event_id", "sink")


@event_query(
    "fl19_typed_promotion",
    "SELECT event_id, CASE WHEN starts_with(full_name, 'shop.v1.ObsP') THEN 'Purchase' WHEN sev_rank >= 5 AND value IS NOT NULL THEN 'Failure' WHEN regexp_matches(full_name, 'Cl[a-z]+k$') THEN 'Click' ELSE 'Forensic' END AS typed FROM env",
)
def promotion(e: DataFrame) -> DataFrame:
    name = F.col("full_name")
    rules = [("Purchase", name.startswith("shop.v1.ObsP")), ("Failure", (F.col("sev_rank") >= 5) & F.col("value").isNotNull()), ("Click", name.rlike("Cl[a-z]+k$"))]
    return e.select("event_id", records.first_match(rules, "Forensic").alias("typed"))


@event_query(
    "ag01_counters", "SELECT 'orders_total' AS name, 'region=' || region AS labels, CAST(sum(k) AS BIGINT) AS total FROM env WHERE event_type = 'purchase' GROUP BY region"
)
def counter(e: DataFrame) -> DataFrame:
    region = F.concat(F.lit("region="), F.col("labels")["region"])
    points = e.where("full_name = 'shop.v1.ObsPurchase'").select(tx.counter_name(F.lit("orders.count")).alias("name"), region.alias("labels"), "k")
    return metrics.counters(points, ["name", "labels"], F.col("k"))


@event_query("ag02_gauges", "SELECT user_id, arg_max(value, row(ts_ns, event_id)) AS last_value FROM env GROUP BY user_id")
def gauge(e: DataFrame) -> DataFrame:
    return metrics.gauges(e, ["user_id"], "value", ["ts_ns", "event_id"])


_COUNTS = ", ".join(f"CAST(sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END) AS BIGINT)" for b in BOUNDS)
_HIST = f", series AS (SELECT full_name, region, [{_COUNTS}] AS buckets, count(value) AS n, sum(value) AS total FROM env GROUP BY full_name, region)"


@event_query("ag03_histograms", _HIST + "SELECT full_name, region, array_to_string(buckets, ',') AS buckets, n, round(total, 4) AS total FROM series")
def histogram(e: DataFrame) -> DataFrame:
    found = metrics.histograms(e.withColumn("region", F.col("labels")["region"]), ["full_name", "region"], "value", BOUNDS)
    return found.select("full_name", "region", F.array_join(F.transform("buckets", lambda x: x.cast("string")), ",").alias("buckets"), "n", F.round("total", 4).alias("total"))


_LES = ", ".join(f"('{int(b)}', {i}, buckets[{i + 1}])" for i, b in enumerate(BOUNDS))


@event_query(
    "sk19_exposition",
    ", series AS (SELECT 'obs_value' AS name, region, ["
    + ", ".join(f"sum(CASE WHEN k <= {int(b)} THEN 1 ELSE 0 END)" for b in BOUNDS)
    + "] AS buckets, count(k) AS n, sum(k) AS total FROM env GROUP BY region)"
    + f"""SELECT name, 'region=' || region AS labels_key, CAST(v.pos AS INTEGER) AS pos, name || '_bucket{{le="' || v.le || '",region="' || region || '"}} ' || CAST(v.c AS BIGINT) AS line FROM series, LATERAL (VALUES {_LES}, ('+Inf', {len(BOUNDS)}, n)) v(le, pos, c)
    UNION ALL SELECT name, 'region=' || region, {len(BOUNDS) + 1}, name || '_sum{{region="' || region || '"}} ' || CAST(total AS BIGINT) FROM series
    UNION ALL SELECT name, 'region=' || region, {len(BOUNDS) + 2}, name || '_count{{region="' || region || '"}} ' || n FROM series
    UNION ALL SELECT 'obs_value', '', -2, '# HELP obs_value series' UNION ALL SELECT 'obs_value', '', -1, '# TYPE obs_value histogram'""".replace("{{", "{").replace("}}", "}"),
)
def exposition(e: DataFrame) -> DataFrame:
    points = e.select(tx.metric_name(F.lit("obs.value")).alias("name"), F.col("labels")["region"].alias("region"), F.col("k").cast("double").alias("k"))
    series = metrics.histograms(points, ["name", "region"], "k", BOUNDS).withColumn("labels", F.create_map(F.lit("region"), F.col("region")))
    return metrics.exposition(series, BOUNDS)


@event_query("ag04_fallback_counts", "SELECT replace(full_name, '.', '_') || '_total' AS name, count(*) AS n FROM env GROUP BY full_name")
def fallback(e: DataFrame) -> DataFrame:
    return e.groupBy("full_name").agg(F.count("*").alias("n")).select(tx.counter_name(F.concat("full_name", F.lit(".count"))).alias("name"), "n")


@event_query(
    "ag05_series_cap",
    """, seen AS (SELECT full_name, region, min(row(ts_ns, event_id)) AS first_at, count(*) AS n FROM env GROUP BY ALL)
    SELECT full_name, region, row_number() OVER (PARTITION BY full_name ORDER BY first_at, region) <= 3 AS admitted, n FROM seen""",
)
def series_cap(e: DataFrame) -> DataFrame:
    return metrics.capped_series(e.withColumn("region", F.col("labels")["region"]), "full_name", "region", ["ts_ns", "event_id"], 3)


@event_query(
    "ag06_promotion_cap",
    """, seen AS (SELECT full_name, user_id, min(row(ts_ns, event_id)) AS first_at FROM env GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY first_at) AS nth FROM seen)
    SELECT e.event_id, e.full_name, e.user_id FROM env e LEFT JOIN ranked c ON c.full_name = e.full_name AND c.nth = 33 WHERE c.nth IS NULL OR row(e.ts_ns, e.event_id) < c.first_at""",
)
def promotion_cap(e: DataFrame) -> DataFrame:
    return metrics.admitted_values(e, "user_id", ["ts_ns", "event_id"], 32, ["full_name"]).select("event_id", "full_name", "user_id")


@event_query("ag07_cardinality_check", "SELECT full_name, count(DISTINCT user_id) AS exact, count(DISTINCT user_id) > 64 AS over_cap, abs(approx_count_distinct(user_id) - count(DISTINCT user_id)) <= greatest(count(DISTINCT user_id) * 0.25, 4) AS close FROM env GROUP BY full_name")
def cardinality(e: DataFrame) -> DataFrame:
    both = e.groupBy("full_name").agg(F.countDistinct("user_id").alias("exact"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return both.select("full_name", "exact", (F.col("about") > 64).alias("over_cap"), (F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.col("exact") * 0.1, F.lit(2))).alias("close"))


@event_query(
    "ag08_delivery_counters",
    f"SELECT tier, CAST(sum(CASE WHEN tier = 'AUDIT' OR sev_rank >= 4 OR {_UNIT} < 0.3 THEN 1 ELSE 0 END) AS BIGINT) AS delivered, CAST(sum(CASE WHEN tier = 'AUDIT' OR sev_rank >= 4 OR {_UNIT} < 0.3 THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM env GROUP BY tier",
)
def delivery(e: DataFrame) -> DataFrame:
    kept = (F.col("tier") == "AUDIT") | sampling.head_decision(0.3)
    return e.groupBy("tier").agg(F.count_if(kept).alias("delivered"), F.count_if(~kept).alias("dropped"))


@event_query("ag11_site_budget", "SELECT region || '/' || bucket AS site, count(*) AS n FROM env GROUP BY ALL HAVING count(*) > 5")
def budget(e: DataFrame) -> DataFrame:
    return e.groupBy(F.concat_ws("/", F.col("labels")["region"], F.col("labels")["bucket"]).alias("site")).agg(F.count("*").alias("n")).where("n > 5")


@event_query("ag12_audit_coverage", "SELECT service, CAST(sum(CASE WHEN tier = 'AUDIT' THEN 1 ELSE 0 END) AS BIGINT) AS n_audit, count(*) AS n FROM env GROUP BY service")
def audit_coverage(e: DataFrame) -> DataFrame:
    return e.groupBy("service").agg(F.count_if(F.col("tier") == "AUDIT").alias("n_audit"), F.count("*").alias("n"))


@event_query(
    "ag15_funnel_cohorts",
    """, firsts AS (SELECT user_id, min(CASE WHEN event_type = 'signup' THEN ts_ns END) AS s, min(CASE WHEN event_type = 'click' THEN ts_ns END) AS c, min(CASE WHEN event_type = 'purchase' THEN ts_ns END) AS p FROM env GROUP BY user_id)
    SELECT CAST(user_id % 5 AS VARCHAR) AS cohort, count(s) AS signed_up, CAST(sum(CASE WHEN c > s THEN 1 ELSE 0 END) AS BIGINT) AS clicked, CAST(sum(CASE WHEN p > c AND c > s THEN 1 ELSE 0 END) AS BIGINT) AS bought FROM firsts GROUP BY ALL""",
)
def funnel(e: DataFrame) -> DataFrame:
    first = lambda x: F.min(F.when(F.col("full_name") == f"shop.v1.Obs{x}", F.col("ts_ns")))
    f = e.groupBy("user_id").agg(first("Signup").alias("s"), first("Click").alias("c"), first("Purchase").alias("p"))
    return f.groupBy((F.col("user_id") % 5).cast("string").alias("cohort")).agg(F.count("s").alias("signed_up"), F.count_if(F.expr("c > s")).alias("clicked"), F.count_if(F.expr("p > c and c > s")).alias("bought"))


@event_query(
    "wn01_error_tail",
    """, held AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts_ns DESC, event_id DESC) AS ring FROM env WHERE sev_rank <= 2 AND trace_id IN (SELECT trace_id FROM env WHERE sev_rank >= 5))
    SELECT event_id, trace_id, 'TAIL_ERROR' AS sampling_reason FROM held WHERE ring <= 4""",
)
def error_tail(e: DataFrame) -> DataFrame:
    return scopes.error_tail(e, most=4).select("event_id", "trace_id", "sampling_reason")


@event_query("wn02_once_per_key", "SELECT user_id, full_name, arg_min(event_id, row(ts_ns, event_id)) AS event_id FROM env GROUP BY user_id, full_name")
def once(e: DataFrame) -> DataFrame:
    return scopes.first_of(e, ["user_id", "full_name"], ["ts_ns", "event_id"]).select("user_id", "full_name", "event_id")


@event_query(
    "wn03_thinned_notices",
    ", n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS nth FROM env WHERE sev_rank >= 5) SELECT event_id, user_id, nth FROM n WHERE nth IN (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536)",
)
def thinned(e: DataFrame) -> DataFrame:
    notices = e.where("sev_rank >= 5").select("event_id", "user_id", "ts_ns")
    return scan.numbered(notices, ["user_id"], ["ts_ns", "event_id"], "nth").where(scopes.thinned(F.col("nth"))).select("event_id", "user_id", "nth")


def _fold_sql(first: str, step: str, state: str) -> str:
    """SQL of a fold over each user's events in order: one round of recursion an event."""
    ordered = "s AS (SELECT user_id, ts_ns, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) AS nth FROM env)"
    steps = f"SELECT n.user_id, n.nth, n.ts_ns, n.event_id, {step} FROM (SELECT s.*, {state} FROM fold f JOIN s ON s.user_id = f.user_id AND s.nth = f.nth + 1) n"
    return ENV_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f", {ordered}, fold AS (SELECT user_id, nth, ts_ns, event_id, {first} FROM s WHERE nth = 1 UNION ALL {steps}) SELECT user_id, event_id FROM fold WHERE admitted"


_BUCKET_SQL = _fold_sql("CAST(4 AS DOUBLE) AS held, true AS admitted", "CASE WHEN held >= 1 THEN held - 1 ELSE held END, held >= 1", "least(5.0::DOUBLE, f.held + (s.ts_ns - f.ts_ns) / 1e9::DOUBLE * (1::DOUBLE / 86400::DOUBLE)) AS held")
_QUIET_SQL = _fold_sql("ts_ns AS held, true AS admitted", f"CASE WHEN n.ts_ns - held >= {6 * 3600 * 10**9} THEN n.ts_ns ELSE held END, n.ts_ns - held >= {6 * 3600 * 10**9}", "f.held AS held")


@query_of_env("wn04_token_bucket", _BUCKET_SQL)
def bucket(e: DataFrame) -> DataFrame:
    return limits.token_bucket(e.select("user_id", "ts_ns", "event_id"), "user_id", rate_per_s=1 / 86400, burst=5).where("admitted").select("user_id", "event_id")


@query_of_env("wn05_debounce", _QUIET_SQL)
def debounce(e: DataFrame) -> DataFrame:
    return limits.debounced(e.select("user_id", "ts_ns", "event_id"), "user_id", gap_ms=6 * 3600 * 1000).where("admitted").select("user_id", "event_id")


_RUNS = f""", marked AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts_ns, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM env WHERE event_type IN ('view', 'purchase')),
    runs AS (SELECT user_id, run, max(CASE WHEN event_type = 'view' THEN row(ts_ns, event_id) END) AS s, max(CASE WHEN event_type = 'purchase' THEN row(ts_ns, event_id) END) AS e FROM marked GROUP BY user_id, run),
    pairs AS (SELECT user_id, s[1] AS start_ns, s[2] AS start_id, e[1] AS end_ns, e[2] AS end_id, coalesce(e[1] - s[1] <= {24 * 3600 * 10**9}, false) AS matched FROM runs)"""


def _pairs(e: DataFrame) -> DataFrame:
    is_ = lambda x: F.col("full_name") == f"shop.v1.Obs{x}"
    return spans.paired(e, "user_id", is_("View"), is_("Purchase"), 24 * 3600 * 10**9)


@event_query("jn03_span_pairs", _RUNS + "SELECT user_id, end_id, CASE WHEN matched THEN start_id END AS start_id, CASE WHEN matched THEN end_ns - start_ns END AS duration_ns FROM pairs WHERE end_id IS NOT NULL")
def pairs(e: DataFrame) -> DataFrame:
    return spans.completed_spans(_pairs(e)).select("user_id", "end_id", "start_id", "duration_ns")


@event_query("jn04_orphans", _RUNS + "SELECT user_id, start_id, start_ns FROM pairs WHERE start_id IS NOT NULL AND NOT matched")
def orphans(e: DataFrame) -> DataFrame:
    return spans.orphans(_pairs(e)).select("user_id", "start_id", "start_ns")


@event_query(
    "jn09_parent_trace",
    """, s AS (SELECT event_id, span_id, CASE WHEN event_id % 3 > 0 THEN substr(md5(CAST(event_id - event_id % 3 AS VARCHAR)), 1, 16) END AS parent, trace_id FROM env)
    SELECT s.event_id, s.parent AS parent_span_id, coalesce(p.trace_id, s.trace_id) AS trace_id FROM s LEFT JOIN s p ON s.parent = p.span_id""",
)
def parent_trace(e: DataFrame) -> DataFrame:
    root = F.substring(F.md5((F.col("event_id") - F.col("event_id") % 3).cast("string")), 1, 16)
    own = e.select("event_id", "span_id", F.when(F.col("event_id") % 3 > 0, root).alias("parent_span_id"), F.col("trace_id").alias("own_trace"))
    return spans.inherited(own).select("event_id", "parent_span_id", "trace_id")


@event_query("pj12_span_records", "SELECT event_id, greatest(ts_ns - k * 1000000, 0) AS start_ns, ts_ns AS end_ns, CASE WHEN sev_rank >= 5 THEN 'ERROR' ELSE 'UNSET' END AS status, 'INTERNAL' AS kind FROM env WHERE tier = 'TRACE' OR sev_rank >= 5")
def span_records(e: DataFrame) -> DataFrame:
    return spans.span_records(e.where("tier = 'TRACE' or sev_rank >= 5"), F.col("k") * 1000000).select("event_id", "start_ns", "end_ns", "status", "kind")


@event_query(
    "pj10_log_records",
    "SELECT event_id, CAST([1, 5, 9, 13, 17, 21][sev_rank] AS INTEGER) AS severity_number, sev AS severity_text, 'bucket=' || bucket || ',event.name=' || full_name || ',event_type=' || event_type || ',obs.sampling_reason=HEAD_RATE,region=' || region AS attributes FROM env",
)
def log_records(e: DataFrame) -> DataFrame:
    return records.log_record(e).select("event_id", "severity_number", "severity_text", labels_text(F.col("attributes")).alias("attributes"))


@event_query(
    "pj11_metric_points",
    "SELECT event_id, metric, point FROM (SELECT event_id, 'latency' AS metric, CAST(value AS DOUBLE) AS point FROM env WHERE event_id % 3 > 0 UNION ALL SELECT event_id, full_name || '.count', 1.0 FROM env WHERE event_id % 3 = 0)",
)
def points(e: DataFrame) -> DataFrame:
    some = e.withColumn("measured", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    return records.metric_points(some, {"measured": "latency"}).select("event_id", "metric", "point")


_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'"


@event_query(
    "sk11_compact_lines",
    f"SELECT event_id, {_ISO} || ' ' || lpad(sev, 5, ' ') || ' ' || split_part(full_name, '.', 3) || '{{' || replace(labels_text, ',', ' ') || '}}: ' || full_name || ': trace_id=' || trace_id || ' span_id=' || span_id AS line FROM env WHERE sev_rank >= 4",
)
def compact(e: DataFrame) -> DataFrame:
    return e.where("sev_rank >= 4").select("event_id", records.compact_line().alias("line"))


@event_query(
    "pj14_tail_lines",
    """SELECT event_id, CAST(ts_ns // 1000000000 AS VARCHAR) || '.' || lpad(CAST(ts_ns % 1000000000 AS VARCHAR), 9, '0') || ' ' || full_name || ' bucket="' || bucket || '" event_type="' || event_type || '" region="' || region || '"' AS line FROM env""",
)
def tail_lines(e: DataFrame) -> DataFrame:
    return e.select("event_id", records.tail_line().alias("line"))


@event_query("pj09_json_lines", """SELECT event_id, '{"full_name":"' || full_name || '","ts_ns":' || ts_ns || ',"trace_id":"' || trace_id || '","service":"' || service || '"}' AS line FROM env""")
def json_lines(e: DataFrame) -> DataFrame:
    return e.select("event_id", records.json_row(["full_name", "ts_ns", "trace_id", "service"]).alias("line"))


@event_query(
    "pj15_bridge_events",
    "SELECT event_id, 'seen ' || event_id AS message, 'api_token=[REDACTED:bridge_pattern],region=' || region AS attrs, 'region=' || region AS labels FROM env WHERE user_id % 6 > 0",
)
def bridge(e: DataFrame) -> DataFrame:
    target = F.when(F.col("user_id") % 6 == 0, "obs.bridge.loop").otherwise("app::shop")
    made = F.create_map(F.lit("message"), F.concat(F.lit("seen "), F.col("event_id").cast("string")), F.lit("api_token"), F.col("span_id"), F.lit("region"), F.col("labels")["region"])
    found = records.bridged(e.select("event_id", target.alias("target"), made.alias("fields")), ["region"])
    return found.select("event_id", "message", labels_text(F.col("attrs")).alias("attrs"), labels_text(F.col("labels")).alias("labels"))


@event_query("pj18_interning", "SELECT event_id, full_name, service, (SELECT count(*) FROM (SELECT DISTINCT full_name, service FROM env)) AS n_callsites, dense_rank() OVER (ORDER BY full_name, service) AS callsite FROM env")
def interning(e: DataFrame) -> DataFrame:
    slim, callsites = records.interned(e.select("event_id", "full_name", "service"), ["full_name", "service"])
    numbered = scan.numbered(callsites, [], ["full_name", "service"], "callsite")
    known = numbered.join(F.broadcast(callsites.agg(F.count("*").alias("n_callsites"))), F.lit(True))  # one row
    return dimensions.split_by_lookup(slim, known, "callsite_id")[0].select("event_id", "full_name", "service", "n_callsites", "callsite")


@event_query("jn02_unresolved_callsites", "SELECT event_id FROM env WHERE service = 'batch'")
def unresolved(e: DataFrame) -> DataFrame:
    slim, callsites = records.interned(e.select("event_id", "full_name", "service"), ["full_name", "service"])
    return dimensions.split_by_lookup(slim, callsites.where("service <> 'batch'"), "callsite_id")[1].select("event_id")


@event_query("jn01_schema_lookup", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'by name' ELSE 'by hash' END || ' ' || event_type AS schema FROM env")
def schema_lookup(e: DataFrame) -> DataFrame:
    hashed = e.withColumn("schema_hash", F.when(F.col("event_id") % 4 > 0, F.xxhash64("full_name")).otherwise(F.lit(0).cast("long")))
    names = e.select("full_name", F.col("labels")["event_type"].alias("kind")).distinct()
    dim = names.select("full_name", F.xxhash64("full_name").alias("schema_hash"), F.concat(F.lit("by hash "), "kind").alias("schema"), F.lit(1).alias("ord"))
    dim = dim.unionByName(dim.select("full_name", F.lit(None).cast("long").alias("schema_hash"), F.replace("schema", F.lit("hash"), F.lit("name")).alias("schema"), F.lit(2).alias("ord")))
    return dimensions.schema_lookup(hashed, dim, ["schema"]).select("event_id", "schema")


@event_query("st01_self_events", """SELECT full_name, sev, count(*) AS n FROM (SELECT full_name, sev FROM env WHERE sev_rank >= 3 UNION ALL SELECT 'obs.runtime.v1.ObsEventFiltered', 'DEBUG' FROM env WHERE sev_rank < 3) GROUP BY ALL""")
def side_output(e: DataFrame) -> DataFrame:
    own = records.self_events(e.where(~filters.allowed("info")), "ObsEventFiltered", "DEBUG", F.create_map(F.lit("event"), F.col("full_name")))
    return e.where(filters.allowed("info")).unionByName(own, allowMissingColumns=True).groupBy("full_name", "sev").agg(F.count("*").alias("n"))


@event_query("st05_replay_dedup", "SELECT DISTINCT ts_ns, full_name, trace_id FROM env")
def replay(e: DataFrame) -> DataFrame:
    keys = ["ts_ns", "full_name", "trace_id"]
    return e.unionByName(e.where("event_id % 5 = 0")).dropDuplicates(keys).select(*keys)


@event_query("sk15_last_n", "SELECT event_id, full_name FROM env ORDER BY ts_ns DESC, event_id DESC LIMIT 1024")
def last_n(e: DataFrame) -> DataFrame:
    return e.orderBy(F.desc("ts_ns"), F.desc("event_id")).limit(1024).select("event_id", "full_name")


@event_query("sk08_json_each_row", """SELECT event_id, '{"full_name":"' || full_name || '","tier":"' || tier || '","sev":"' || sev || '","payload":"' || base64(encode(props)) || '"}' AS line FROM env""")
def json_each_row(e: DataFrame) -> DataFrame:
    return e.withColumn("payload", F.base64(F.encode("props", "UTF-8"))).select("event_id", records.json_row(["full_name", "tier", "sev", "payload"]).alias("line"))


@event_query(
    "sk13_level_split",
    "SELECT CASE WHEN sev_rank >= 4 THEN 'err' ELSE 'out' END AS stream, tier, count(*) AS n FROM env GROUP BY ALL",
)
def level_split(e: DataFrame) -> DataFrame:
    return e.withColumn("stream", F.when(F.col("sev_rank") >= 4, "err").otherwise("out")).groupBy("stream", "tier").agg(F.count("*").alias("n"))


@event_query("fn01_severity_names", "SELECT event_id, sev AS parsed, sev_rank FROM env")
def severities(e: DataFrame) -> DataFrame:
    odd = F.when(F.col("sev") == "WARN", "Warning").when(F.col("sev") == "ERROR", "err").when(F.col("sev") == "INFO", "severity_info").otherwise(F.lower("sev"))
    parsed = severity_name(odd)
    return e.select("event_id", parsed.alias("parsed"), sev_rank(parsed).alias("sev_rank"))


@event_query("fn14_traceparent", "SELECT event_id, trace_id, span_id, event_id % 2 = 1 AS sampled FROM env WHERE event_id % 5 > 0")
def parents(e: DataFrame) -> DataFrame:
    header = tx.render_traceparent(F.col("trace_id"), F.col("span_id"), F.col("event_id") % 2 == 1)
    found = tx.traceparent(F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("x"), header)).otherwise(header))
    return e.select("event_id", found.alias("c")).where("c is not null").select("event_id", "c.trace_id", "c.span_id", "c.sampled")


@event_query("fn16_date_hour", "SELECT service, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM env GROUP BY ALL")
def dates(e: DataFrame) -> DataFrame:
    at = tx.date_hour(F.col("ts_ns"))
    return e.select("service", at["date"].alias("date"), at["hour"].alias("hour")).groupBy("service", "date", "hour").agg(F.count("*").alias("n"))


@event_query("fn26_scrub", "SELECT event_id, CASE WHEN event_id % 3 > 0 THEN '<redacted-props>' END AS props, CAST(NULL AS VARCHAR) AS user_id, CAST(k AS VARCHAR) AS k FROM env")
def scrubbed(e: DataFrame) -> DataFrame:
    e = e.withColumn("props", F.when(F.col("event_id") % 3 > 0, F.col("props")))
    return e.select("event_id", tx.scrub(F.col("props"), "props", "PII", True).alias("props"), tx.scrub(F.col("user_id"), "user_id", "PII", False).alias("user_id"), tx.scrub(F.col("k"), "k", "INTERNAL", False).cast("string").alias("k"))


@event_query("fn29_backoff", "SELECT DISTINCT k, CAST(least(1000 * 2 ** (k - 1), 30000) AS BIGINT) AS wait_ms FROM env WHERE k > 0")
def backoff(e: DataFrame) -> DataFrame:
    return e.where("k > 0").select("k", tx.backoff_ms(F.col("k")).alias("wait_ms")).distinct()


@event_query("sr14_hourly", "SELECT (ts_ns // 3600000000000) * 3600000000000 AS hour_start_ns, full_name, count(*) AS n FROM env GROUP BY ALL")
def hourly(e: DataFrame) -> DataFrame:
    hour = 3600 * 10**9
    return e.groupBy((F.col("ts_ns") - F.col("ts_ns") % hour).alias("hour_start_ns"), "full_name").agg(F.count("*").alias("n"))
