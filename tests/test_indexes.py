"""Indexes, bitmaps, sketches and layouts against plain evaluation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.functions import filters
from eventloom.functions.envelope import from_events
from eventloom.operators import cardinality, directives, exports, retention, subscriptions
from eventloom.plans import index_queries
from eventloom.plans.registry import QUERIES
from eventloom.sinks import tables


@pytest.fixture(scope="module")
def events(spark, sf):
    return from_events(spark.read.parquet(f"{sf}/events.parquet")).cache()


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_ten_thousand_subscribers(spark, events):
    rng = np.random.default_rng(3)
    kinds = ["click", "view", "purchase", "signup", "error"]
    subs = []
    for i in range(10_000):
        labels = {}
        if rng.random() < 0.9:
            labels["region"] = str(rng.integers(0, 6))
        if rng.random() < 0.8 or not labels:
            labels["bucket"] = str(rng.integers(0, 12))
        if rng.random() < 0.3:
            labels["event_type"] = str(rng.choice(kinds))
        subs.append((i, int(rng.integers(1, 7)), labels))
    subs += [(10_000, 6, {}), (10_001, 5, None), (10_002, 7, {}), (10_003, 1, {"none": "x"})]
    table = spark.createDataFrame(subs, "name long, sev_rank int, labels map<string,string>")
    got = subscriptions.matched(events, table)
    assert len(_plan(got)) < 60_000  # no expression a subscriber
    found = {}
    for r in got.groupBy("subscriber").agg(F.collect_list("event_id").alias("ids")).collect():
        found[r.subscriber] = sorted(r.ids)
    rows = [(r.event_id, r.sev_rank, r.labels) for r in events.select("event_id", "sev_rank", "labels").collect()]
    for name, least, labels in subs[::41] + subs[-4:]:
        want = sorted(e for e, s, have in rows if s >= least and all(have.get(k) == v for k, v in (labels or {}).items()))
        assert found.get(name, []) == want
    some = got.where("subscriber < 40")
    first = {r.subscriber: r.ids for r in subscriptions.capped(some, 2, ["ts_ns", "event_id"]).groupBy("subscriber").agg(F.collect_set("event_id").alias("ids")).collect()}
    order = {r.event_id: (r.ts_ns, r.event_id) for r in events.select("event_id", "ts_ns").collect()}
    assert {k: sorted(v) for k, v in first.items()} == {k: sorted(sorted(v, key=order.get)[:2]) for k, v in found.items() if k < 40}


@pytest.mark.parametrize("name", ["ag10_indexed_counts", "jn12_subscription_index", "sk20_capped_tail"])
def test_subscribers_that_ask_alike_are_matched_once(name, spark, sf, tmp_path, monkeypatch):
    customers, pairs = spark.read.parquet(f"{sf}/customer.parquet"), []
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(f"{tmp_path}/events.parquet")
    n = customers.count()
    # 750 numbers on, a customer asks for the same again
    customers.crossJoin(spark.range(100).select(F.col("id").alias("i"))).withColumn("c_custkey", F.col("c_custkey") + F.col("i") * 750).drop("i").write.parquet(f"{tmp_path}/customer.parquet")
    plain = subscriptions.matched

    def counted(*given):
        found = plain(*given)
        pairs.append(found.count())
        return found

    own = {r.subscriber: r for r in plain(index_queries.env(spark, sf), index_queries._subscribers(spark, sf)).groupBy("subscriber").agg(F.count("*").alias("n"), F.min("event_id").alias("a"), F.max("event_id").alias("b")).collect()}
    monkeypatch.setattr(subscriptions, "matched", counted)
    found = QUERIES[name](spark, str(tmp_path)).collect()
    assert n == 150 and sum(pairs) <= 2 * sum(r.n for r in own.values())  # not 100 times as many
    assert len({r.subscriber for r in found}) == 100 * len(own)
    for r in found:
        want = own[r.subscriber % 750]
        if name == "ag10_indexed_counts":
            assert (r.delivered, r.dropped) == (min(want.n, 50), max(want.n - 50, 0))
        elif name == "jn12_subscription_index":
            assert (r.n, r.first_id, r.last_id) == (want.n, want.a, want.b)


def test_tallies_of_repeated_names(spark, events):
    subs = [(1, 2, {"region": "1"}), (1, 2, {"region": "1"}), (1, 5, None), (2, 5, {}), (3, 1, {"region": None}), (4, None, {}), (5, 1, {"bucket": "2", "region": "1"})]
    table = spark.createDataFrame(subs, "name long, sev_rank int, labels map<string,string>")
    rows = events.select("event_id", "ts_ns", "sev_rank", "labels").collect()
    hits = {}
    for name, least, labels in subs:
        met = [(r.ts_ns, r.event_id) for r in rows if least is not None and r.sev_rank >= least and all(v is not None and r.labels.get(k) == v for k, v in (labels or {}).items())]
        hits[name] = sorted(hits.get(name, []) + met)
    hits = {k: v for k, v in hits.items() if v}
    ids = {k: [e for _, e in v] for k, v in hits.items()}
    assert {r.subscriber: (r.n, r.first_id, r.last_id) for r in subscriptions.tallied(events, table).collect()} == {k: (len(v), min(v), max(v)) for k, v in ids.items()}
    got = {}
    for r in subscriptions.first_events(events, table, 3, ["ts_ns", "event_id"]).collect():
        got[r.subscriber] = sorted([*got.get(r.subscriber, []), (r.ts_ns, r.event_id)])
    assert got == {k: v[:3] for k, v in hits.items()}


def _rules(n, seed):
    rng = np.random.default_rng(seed)
    words = [w.lower() for w in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")] + ["off"]
    parts = ["warn"]
    for _ in range(n):
        sep = str(rng.choice([".", "::"]))
        target = sep.join(["shop", *(f"p{rng.integers(0, 12)}" for _ in range(rng.integers(0, 4)))])
        labels = f"[region={rng.integers(0, 4)}]" if rng.random() < 0.1 else f"[region={rng.integers(0, 4)},bucket={rng.integers(0, 9)}]" if rng.random() < 0.1 else ""
        parts.append(f"{target}{labels}" + ("" if rng.random() < 0.1 else f"={rng.choice(words)}"))
    return ",".join(parts)


def _passes(rules, name, sev, labels):
    """Plain code for a filter: label directives in order, then the longest target, then the floor."""
    level = rules.floor
    own = [d.level for d in rules.dynamic if d.target == name and all(labels.get(k) == v for k, v in d.labels)]
    under = [d for d in rules.static if name is not None and (name == d.target or name.startswith((d.target + ".", d.target + "::")))]
    if own:
        level = own[0]
    elif under:
        level = under[0].level
    return level > 0 and sev >= level


def _named(events):
    h = F.xxhash64("event_id")
    part = lambda k: F.concat(F.lit("p"), F.pmod(F.shiftrightunsigned(h, 7 * k), F.lit(12)).cast("string"))
    dotted = F.concat_ws(".", F.lit("shop"), part(0), part(1), part(2))
    colons = F.concat_ws("::", F.lit("shop"), part(0), part(1))
    return events.withColumn("full_name", F.when(F.col("event_id") % 5 == 0, colons).when(F.col("event_id") % 17 == 0, F.lit(None)).when(F.col("event_id") % 13 == 0, "shopping.p1").otherwise(dotted))


@pytest.mark.parametrize("seed", [1, 2])
def test_indexed_directives_equal_conditions(events, seed):
    rows, rules = _named(events), filters.parse(_rules(120, seed))
    want = {r.event_id for r in rows.select("event_id", "full_name", "sev_rank", "labels").collect() if _passes(rules, r.full_name, r.sev_rank, r.labels)}
    got = directives.admitted(rows, rules)
    assert {r.event_id for r in got.select("event_id").collect()} == want and 0 < len(want) < rows.count()


def test_five_thousand_directives_have_a_small_plan(events):
    few, many = (directives.admitted(_named(events), _rules(n, 5)) for n in (50, 5000))
    assert len(_plan(many)) < 1.5 * len(_plan(few))


def test_known_names_reach_the_scan(spark, events, tmp_path):
    events.select("event_id", "full_name", "sev_rank", "labels").write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    rules = "off,shop.v1.ObsClick=debug,shop.v1.ObsView[region=1],shop.v1.ObsError=off,shop.v1.ObsError[region=2]=off"
    known = [r[0] for r in stored.select("full_name").distinct().collect()]
    assert directives.passing_names(known, rules, spark) == ["shop.v1.ObsClick", "shop.v1.ObsView"]
    got = directives.pruned(stored, rules, known)
    assert "PushedFilters: [In(full_name, [shop.v1.ObsClick,shop.v1.ObsView])" in _plan(got)
    assert {r.event_id for r in got.collect()} == {r.event_id for r in stored.where(filters.allowed(rules)).collect()}


def test_retention_equals_a_self_join(spark):
    rng = np.random.default_rng(6)
    rows = [(int(u), int(d)) for u, d in zip(rng.integers(0, 60, 900), rng.integers(90, 330, 900), strict=True)] + [(None, 100), (7, None), (8, 5), (9, 10_000)] * 3
    df = spark.createDataFrame(rows, "user long, day long")
    got = {(r.cohort, r.day_n): r.users for r in retention.retention(df, "user", F.col("day"), 90, 330).collect()}
    days = {}
    for u, d in rows:
        if u is not None and d is not None and 90 <= d <= 330:
            days.setdefault(u, set()).add(d)
    want = {}
    for mine in days.values():
        for d in mine:
            at = (min(mine), d - min(mine))
            want[at] = want.get(at, 0) + 1
    assert got == want
    plan = _plan(retention.active_days(df, "user", F.col("day"), 90, 330))
    assert plan.split("Physical Plan")[-1].count("Exchange") == 1 and "Join" not in plan


def test_sketches_merge_and_only_near_groups_are_counted(spark, tmp_path):
    df = spark.range(40_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, F.col("id") % 300).when(F.col("id") % 3 == 1, F.col("id") % 1500).otherwise(F.col("id")).alias("v"), (F.col("id") * 10**9).alias("ts_ns"))
    first, second = df.where("v % 2 = 0"), df.where("v % 2 = 1")
    for part in (first, second, first):  # a replayed part changes nothing
        cardinality.store(part, ["g"], "v", f"{tmp_path}/s")
    kept = cardinality.stored(spark, f"{tmp_path}/s")
    exact = {r.g: r.n for r in df.groupBy("g").agg(F.countDistinct("v").alias("n")).collect()}
    for r in cardinality.estimated(kept, ["g"]).collect():
        assert r.low <= exact[r.g] <= r.high
    for cap in (99, 100, 499, 500, 2000):
        told = {r.g: (r.over, r.counted) for r in cardinality.over_cap(df, kept, ["g"], "v", cap).collect()}
        assert {g: o for g, (o, _) in told.items()} == {g: n > cap for g, n in exact.items()}
        assert not told[2][1] and (cap in (99, 100)) == told[0][1]


def _scanned(df):
    """Rows that the plan's file scans give, after it has run."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if node.nodeName().startswith("Scan"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_bloom_filters_skip_row_groups(spark, events, tmp_path):
    tables.write(events, f"{tmp_path}/t")
    stored = tables.read(spark, f"{tmp_path}/t")
    low, high = stored.agg(F.min("trace_id"), F.max("trace_id")).first()
    absent = low[:-1] + ("1" if low[-1] == "0" else "0") if low[-1] != "f" else low[:-2] + "zz"
    absent = max(absent, low + "0")
    assert low < absent < high
    assert _scanned(stored.where(F.col("trace_id") == absent).select("event_id")) < events.count() / 20
    files = stored.select(F.input_file_name().alias("f")).distinct().count()
    assert files <= stored.select("service", "date").distinct().count() * 1.2  # small partitions are a file each


def test_a_hot_partition_is_split(spark, tmp_path):
    df = spark.range(200_000).select(F.lit("web").alias("service"), (F.lit(1704067200 * 10**9) + F.col("id")).alias("ts_ns"), F.md5(F.col("id").cast("string")).alias("trace_id"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        tables.write(df.repartition(16), f"{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    stored = tables.read(spark, f"{tmp_path}/t")
    assert stored.select(F.input_file_name()).distinct().count() >= 3 and stored.count() == 200_000


def test_root_traces_end_on_cycles_and_repeated_ids(spark):
    rows = [("a", "a", "ta"), ("b", "c", "tb"), ("c", "b", "tc"), ("d", "b", "td"), ("r", None, "tr"), ("s", "r", "ts"), ("s", "r", "ts2"), ("u", "s", "tu"), ("v", "gone", "tv"), (None, "r", "tn"), ("w", "v", "tw")]
    tree = spark.createDataFrame(rows, "span_id string, parent_span_id string, own_trace string")
    got = sorted((r.span_id or "", r.own_trace, r.trace_id) for r in exports.root_traces(tree).collect())
    assert got == sorted([("a", "ta", "ta"), ("b", "tb", "tb"), ("c", "tc", "tc"), ("d", "td", "td"), ("r", "tr", "tr"), ("s", "ts", "tr"), ("s", "ts2", "tr"), ("u", "tu", "tr"), ("v", "tv", "tv"), ("", "tn", "tn"), ("w", "tw", "tv")])


def test_resources_of_senders(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 5), (4, None)], "event_id long, sender int")
    got = {r.event_id: (r.host_name, dict(r.attrs)) for r in exports.with_resources(rows, "sender", {0: {"host.name": "h"}, 1: {"team": "a"}}).collect()}
    assert got == {1: ("h", {}), 2: (None, {"team": "a"}), 3: (None, {}), 4: (None, {})}
