"""Queries of the indexed, sketched and observed operators and of streams with timers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.envelope import ENV_SQL
from eventloom.operators import cardinality, counting, directives, retention, sampling, subscriptions
from eventloom.plans.event_queries import _UNIT, env, event_query, table
from eventloom.plans.registry import query
from eventloom.plans.storage import drained, shared_path
from eventloom.sinks import tables
from eventloom.streaming import timers

# Subscriptions: one for each customer, by labels, by labels and kind of event, or by severity alone.

_KINDS = ("click", "view", "purchase", "signup", "error")
_WANTED = (
    ", want AS (SELECT c_custkey AS name, c_custkey % 6 + 1 AS least, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey % 5 AS VARCHAR) END AS region, CASE WHEN c_custkey % 3 < 2 THEN CAST(c_custkey // 5 % 10 AS VARCHAR) END AS bucket,"
    + f" CASE WHEN c_custkey % 3 = 1 THEN {list(_KINDS)}[c_custkey // 50 % 5 + 1] END AS kind FROM customer WHERE c_custkey % 3 < 2 OR c_custkey % 6 >= 4),"
    + " hits AS (SELECT w.name AS subscriber, e.* FROM want w JOIN env e ON e.sev_rank >= w.least AND (w.region IS NULL OR w.region = e.region) AND (w.bucket IS NULL OR w.bucket = e.bucket) AND (w.kind IS NULL OR w.kind = e.event_type))"
)


def _subscribers(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = F.get(F.array(*(F.lit(k) for k in _KINDS)), (F.floor(key / 50) % 5).cast("int"))
    two = F.create_map(F.lit("region"), (key % 5).cast("string"), F.lit("bucket"), (F.floor(key / 5) % 10).cast("string"))
    labels = F.when(key % 3 == 0, two).when(key % 3 == 1, F.map_concat(two, F.create_map(F.lit("event_type"), kind)))
    return table(spark, d, "customer").where((key % 3 < 2) | (key % 6 >= 4)).select(key.alias("name"), (key % 6 + 1).cast("int").alias("sev_rank"), labels.alias("labels"))


@query("jn12_subscription_index", ENV_SQL + _WANTED + " SELECT subscriber, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM hits GROUP BY subscriber")
def subscription_index(spark: SparkSession, d: str) -> DataFrame:
    return subscriptions.tallied(env(spark, d), _subscribers(spark, d))


@query("sk20_capped_tail", ENV_SQL + _WANTED + " SELECT subscriber, event_id FROM hits QUALIFY row_number() OVER (PARTITION BY subscriber ORDER BY ts_ns, event_id) <= 3")
def capped_tail(spark: SparkSession, d: str) -> DataFrame:
    """The first three events of each subscriber: what fits into its buffer."""
    return subscriptions.first_events(env(spark, d), _subscribers(spark, d), 3, ["ts_ns", "event_id"]).select("subscriber", "event_id")


@query("ag10_indexed_counts", ENV_SQL + _WANTED + " SELECT subscriber, least(count(*), 50) AS delivered, greatest(count(*) - 50, 0) AS dropped FROM hits GROUP BY subscriber")
def indexed_counts(spark: SparkSession, d: str) -> DataFrame:
    return subscriptions.delivery(subscriptions.tallied(env(spark, d), _subscribers(spark, d)), 50)


# Directives: a filter with one for every region and bucket, over names that hold both.


def _deep_filter() -> str:
    """A directive a kind and region, one a bucket under some of them, and some with label conditions."""
    names = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
    parts = ["error"]
    for kind in ("Click", "View", "Error"):
        for r in range(5):
            parts.append(f"shop.v1.Obs{kind}.{r}={names[r]}")
            parts += [f"shop.v1.Obs{kind}.{r}.{b}={'off' if b == 9 else names[(b + r) % 6]}" for b in range(0, 10, 3)]
    parts += [f"shop.v1.ObsView.2.{b}[service=web]=trace" for b in range(1, 10, 3)]
    return ",".join(parts)


_DEEP_SQL = """, deep AS (SELECT event_id, sev_rank, service, full_name || '.' || region || '.' || bucket AS name, CAST(region AS INTEGER) AS r, CAST(bucket AS INTEGER) AS b, event_type FROM env)
    SELECT event_id, name FROM deep WHERE CASE WHEN event_type = 'view' AND r = 2 AND b % 3 = 1 AND b < 10 AND service = 'web' THEN true
      WHEN event_type NOT IN ('click', 'view', 'error') THEN sev_rank >= 5 WHEN b = 9 THEN false WHEN b % 3 = 0 AND b < 10 THEN sev_rank >= (b + r) % 6 + 1 ELSE sev_rank >= r + 1 END"""


@event_query("fl02_directive_index", _DEEP_SQL)
def directive_index(e: DataFrame) -> DataFrame:
    deep = e.withColumn("name", F.concat_ws(".", "full_name", F.col("labels")["region"], F.col("labels")["bucket"]))
    deep = deep.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("service"), F.col("service"))))
    return directives.admitted(deep, _deep_filter(), name="name").select("event_id", "name")


@query("fl03_pruned_names", ENV_SQL + "SELECT event_id, full_name FROM env WHERE CASE WHEN event_type = 'click' THEN region = '1' AND sev_rank >= 2 WHEN event_type = 'view' THEN true WHEN event_type = 'purchase' THEN false ELSE sev_rank >= 4 END")
def pruned_names(spark: SparkSession, d: str) -> DataFrame:
    """A filter over a stored table: names that can't pass are left out by the scan."""
    at = shared_path(spark, "stored")
    env(spark, d).select("event_id", "full_name", "sev_rank", "labels").write.parquet(at)
    known = [r[0] for r in spark.read.parquet(at).select("full_name").distinct().limit(directives.MOST_NAMES + 1).collect()]
    rules = "warn,shop.v1.ObsClick[region=1]=debug,shop.v1.ObsClick=off,shop.v1.ObsView,shop.v1.ObsPurchase=off"
    return directives.pruned(spark.read.parquet(at), rules, known).select("event_id", "full_name")


# Retention, sketches, observed counters, layout.

_FIRST_DAY, _LAST_DAY = 19723, 19723 + 365  # 2024-01-01 and a year on


@event_query(
    "jn11_retention",
    f""", active AS (SELECT DISTINCT user_id, ts_ns // {86400 * 10**9} AS day FROM env), firsts AS (SELECT user_id, min(day) AS cohort FROM active GROUP BY user_id)
    SELECT cohort, a.day - cohort AS day_n, count(*) AS users FROM firsts f JOIN active a USING (user_id) GROUP BY ALL""",
)
def cohort_retention(e: DataFrame) -> DataFrame:
    day = F.expr(f"ts_ns div {86400 * 10**9}")
    found = retention.retention(e, "user_id", day, _FIRST_DAY, _LAST_DAY)
    return found.select(F.col("cohort").cast("long").alias("cohort"), F.col("day_n").cast("long").alias("day_n"), "users")


@query("ag07_stored_sketches", ENV_SQL + "SELECT full_name, count(DISTINCT user_id) > 14 AS over_cap, true AS close FROM env GROUP BY full_name")
def stored_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Hourly sketches, stored, merged by name; names near the cap counted exactly; estimates within the stated error."""
    at, e = shared_path(spark, "sketches"), env(spark, d)
    cardinality.store(e, ["full_name"], "user_id", at)
    kept = cardinality.stored(spark, at)
    told = cardinality.over_cap(e, kept, ["full_name"], "user_id", 14)
    exact = e.groupBy("full_name").agg(F.countDistinct("user_id").alias("exact"))
    within = F.abs(F.col("about") - F.col("exact")) <= F.greatest(F.col("exact") * (cardinality.SIGMAS * cardinality.ERROR), F.lit(1.0))
    return told.join(exact, "full_name").select("full_name", F.col("over").alias("over_cap"), within.alias("close"))


@query(
    "ag08_observed_counters",
    ENV_SQL + f"SELECT tier, CAST(sum(CASE WHEN keep THEN 1 ELSE 0 END) AS BIGINT) AS delivered, CAST(sum(CASE WHEN keep THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM (SELECT tier, tier = 'AUDIT' OR sev_rank >= 4 OR {_UNIT} < 0.3 AS keep FROM env) GROUP BY tier",
)
def observed_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the pass that writes the kept events; none is read again for them."""
    kept = (F.col("tier") == "AUDIT") | sampling.head_decision(0.3)
    tiers = ["LOG", "METRIC", "TRACE", "AUDIT"]
    at = shared_path(spark, "delivered")
    seen = counting.counted_write(env(spark, d), kept, counting.delivered_and_dropped(kept, F.col("tier"), tiers), lambda rows: rows.select("event_id", "tier").write.parquet(at))
    rows = [(t, seen[f"delivered_{t}"], seen[f"dropped_{t}"]) for t in tiers]
    return spark.createDataFrame([r for r in rows if r[1] + r[2]], "tier string, delivered long, dropped long")


@query("sk01_trace_lookup", ENV_SQL + ", one AS (SELECT min(trace_id) AS trace_id FROM env) SELECT event_id, service, ts_ns FROM env WHERE trace_id = (SELECT trace_id FROM one)")
def trace_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One trace's events from a stored table: its row groups' Bloom filters leave out those without it."""
    at, e = shared_path(spark, "lookup"), env(spark, d)
    tables.write(e, at)
    one = e.agg(F.min("trace_id")).first()[0]
    return tables.read(spark, at).where(F.col("trace_id") == F.lit(one)).select("event_id", "service", "ts_ns")


# Streams with timers.

_HELD = 6 * 3600 * 10**9
_NEIGHBOURS = f""", s AS (SELECT user_id, event_id, ts_ns, event_type = 'purchase' AS is_end, lag(event_type = 'view') OVER w AS after_start, lag(ts_ns) OVER w AS p_ns, lag(event_id) OVER w AS p_id, lead(ts_ns) OVER w AS n_ns
    FROM env WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts_ns, event_id))
    SELECT user_id, 'completed' AS outcome, CASE WHEN after_start AND ts_ns - p_ns <= {_HELD} THEN p_id END AS start_id, event_id AS end_id FROM s WHERE is_end
    UNION ALL SELECT user_id, 'orphan', event_id, NULL FROM s WHERE NOT is_end AND coalesce(n_ns - ts_ns > {_HELD}, true)"""

_FAR = 4_000_000_000 * 10**9


def _streamed(spark: SparkSession, rows: DataFrame, label: str) -> DataFrame:
    """``rows`` as a stream of files, with a last row far ahead in time that closes all others."""
    at = shared_path(spark, label)
    last = spark.range(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(_FAR).alias("ts_ns"), F.lit(-1).cast("long").alias("event_id"), F.lit("start").alias("kind"))
    rows.unionByName(last).write.parquet(at)
    return spark.readStream.schema("user_id long, ts_ns long, event_id long, kind string").parquet(at).withColumnRenamed("event_id", "id")


@query("sr08_timed_pairs", ENV_SQL + _NEIGHBOURS)
def timed_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a stream: a later Started overwrites, an orphan leaves by a timer."""
    e = env(spark, d).where("full_name in ('shop.v1.ObsView', 'shop.v1.ObsPurchase')")
    rows = e.select("user_id", "ts_ns", "event_id", F.when(F.col("full_name") == "shop.v1.ObsView", "start").otherwise("end").alias("kind"))
    with timers.rocksdb(spark):
        found = drained(timers.pairs(_streamed(spark, rows, "starts"), "user_id", _HELD), "timed-pairs")
    return found.where("user_id >= 0").select("user_id", "outcome", "start_id", "end_id")


@query(
    "sr09_stream_expiry",
    ENV_SQL
    + f""", gaps AS (SELECT user_id, ts_ns, event_id, coalesce(ts_ns - lag(ts_ns) OVER (PARTITION BY user_id ORDER BY ts_ns, event_id) > {_HELD}, true) AS anew FROM env),
    lives AS (SELECT *, sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts_ns, event_id ROWS UNBOUNDED PRECEDING) AS life FROM gaps)
    SELECT user_id, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(*) AS n FROM lives GROUP BY user_id, life""",
)
def stream_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Series that leave a stream's state when they are idle for too long, by timers."""
    rows = env(spark, d).select("user_id", "ts_ns", "event_id", F.lit("").alias("kind"))
    with timers.rocksdb(spark):
        found = drained(timers.expiring_series(_streamed(spark, rows, "points"), "user_id", _HELD), "lives")
    return found.where(F.col("last_ns") < _FAR)
