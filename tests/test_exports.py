"""Sinks, settings and shared folders beside the catalogue's queries."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import config
from eventloom.functions.envelope import from_events
from eventloom.operators import exports, governance, metrics, spans
from eventloom.plans import storage
from eventloom.sinks import tables


@pytest.fixture(scope="module")
def events(spark, sf):
    return from_events(spark.read.parquet(f"{sf}/events.parquet"))


def test_batches_go_over_jdbc_once_or_are_refused(spark, events, tmp_path):
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    put = tables.put_jdbc(url, "events", options)
    rows = events.select("event_id", "k").limit(50)
    put(rows, 0)
    put(rows, 1)
    found = spark.read.format("jdbc").options(url=url, dbtable="events", **options).load()
    assert {(r[0], r[1]) for r in found.groupBy("batch_number").count().collect()} == {(0, 50), (1, 50)}
    refused = []
    tables.put_jdbc("jdbc:nothing:x", "events", attempts=2, refused=lambda b, n, e: refused.append(n))(rows, 7)
    assert refused == [7]
    with pytest.raises(Exception):
        tables.put_jdbc("jdbc:nothing:x", "events", attempts=1)(rows, 8)


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://far:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda k, d=None: d)

    with pytest.raises(ValueError):
        storage.shared_folder(Session())


def test_settings_refuse_unknown_keys():
    with pytest.raises(ValueError):
        config.from_yaml("nothing: 1", {})
    with pytest.raises(ValueError):
        config.from_yaml("filter: info", {"OBS_LIMITS__NOTHING": "1"}, "obs")
    assert config.from_yaml("", {}) == config.Settings()
    assert config.expanded("${A} ${B:-b} ${C:-}", {"C": "c"}) == "${A} b c"


@pytest.mark.parametrize("deals", [1, 7])
def test_series_cap_equals_first_appearance(spark, events, monkeypatch, deals):
    monkeypatch.setattr(metrics, "DEALS", deals)
    points = events.select("service", "full_name", "ts_ns", "event_id", F.concat_ws("/", "k", F.col("labels")["region"]).alias("series"))
    found = {(r.service, r.series) for r in metrics.capped_series(points, "service", "series", ["ts_ns", "event_id"], 9).where("admitted").collect()}
    seen, expected = {}, set()
    for r in points.orderBy("ts_ns", "event_id").collect():
        mine = seen.setdefault(r.service, [])
        if r.series not in mine and len(mine) < 9:
            mine.append(r.series)
            expected.add((r.service, r.series))
    assert found == expected


def test_empty_inputs(spark, events):
    none = events.limit(0)
    for made in (exports.otlp_logs(none), exports.log_lines(none, "props"), exports.with_resource(none, {"host.name": "h"}), exports.identity_filled(none, service="s"), none.select(exports.full_lines(none, "props"))):
        assert made.collect() == []
    tree = spark.createDataFrame([], "span_id string, parent_span_id string, own_trace string")
    assert exports.root_traces(tree).collect() == []


def test_repeated_spans_multiply_no_row(spark):
    rows = [("p", None, "t2"), ("p", None, "t1"), ("c", "p", "t3"), ("d", "none", "t4"), (None, None, "t5"), ("f", None, None)]
    found = spans.inherited(spark.createDataFrame(rows, "span_id string, parent_span_id string, own_trace string"))
    assert sorted((r.span_id or "", r.own_trace or "", r.trace_id or "") for r in found.collect()) == [("", "t5", "t5"), ("c", "t3", "t1"), ("d", "t4", "t4"), ("f", "", ""), ("p", "t1", "t1"), ("p", "t2", "t2")]


def test_budgets_of_sites(spark):
    notes = spark.createDataFrame([({"site": s, "waived": w},) for s, w in [("a", "false")] * 6 + [("b", "true")] * 9 + [("c", None)] * 3], "labels map<string,string>")
    own = spark.createDataFrame([("c", 2), ("c", 9), ("z", 0)], "site string, budget int")
    assert sorted(tuple(r) for r in governance.over_budget(notes, own, 5).collect()) == [("a", 6, 0, 5), ("c", 3, 0, 2)]
