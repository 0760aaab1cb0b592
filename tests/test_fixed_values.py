"""Parsers, settings, schemas and checksums against published or written-out values."""

import pytest
from pyspark.sql import functions as F

from eventloom.functions import config, filters, text, wire
from eventloom.operators import governance, metrics
from eventloom.sinks import tables
from eventloom.sources import schemas

DURATIONS = {"250ms": 250_000_000, "5s": 5_000_000_000, "10m": 600_000_000_000, "2h": 7_200_000_000_000, "1d": 86_400_000_000_000, "5": None, "1w": None, "": None, "-1s": None, " 7 s ": 7 * 10**9, "999999999999999999d": None}

#: The published CRC-32C of 32 bytes of zeros, of ones, rising from 0, falling from 31, and of the digits.
CRC = [(b"\x00" * 32, 0x8A9136AA), (b"\xff" * 32, 0x62A8AB43), (bytes(range(32)), 0x46DD794E), (bytes(range(31, -1, -1)), 0x113FDB5C), (b"123456789", 0xE3069283)]

FILTERS = {
    "info": [("", "", 3)],
    "off": [("", "", 0)],
    "warn,myapp.v1.ObsA=debug": [("", "", 4), ("myapp.v1.ObsA", "", 2)],
    "myapp::auth": [("", "", 3), ("myapp::auth", "", 1)],
    'error,a.b[k=v,x="p,q"]=trace,c=OFF': [("", "", 5), ("a.b", "k=v,x=p,q", 1), ("c", "", 0)],
    " Warning , x-y = err ": [("", "", 4), ("x-y", "", 5)],
    "myapp::auth=BOGUS": None,
    "myapp[route=admin=info": None,
}

YAML = "filter: ${FILTER:-warn}\nsampling:\n  default_rate: ${RATE}\n  per_event: {a.b: 0.5, c.d: 7}\nlimits:\n  max_payload_bytes: 512\n"


def test_durations(spark):
    df = spark.createDataFrame([(x,) for x in [*DURATIONS, None]], "x string")
    assert dict(df.select("x", text.duration_column(F.col("x"))).collect()) == {**DURATIONS, None: None}
    for x, ns in DURATIONS.items():
        if ns is not None:
            assert text.duration_ns(x) == ns


def test_checksums():
    assert [wire.crc32c(x) for x, _ in CRC] == [v for _, v in CRC]
    assert wire.id64("").to_bytes(8, "little").hex() == "af1349b9f5f9a1a6"
    assert wire.id64("\x00").to_bytes(8, "little").hex() == "2d3adedff11b61f1"


@pytest.mark.parametrize("given", FILTERS)
def test_filter_texts(given):
    if FILTERS[given] is None:
        with pytest.raises(ValueError):
            filters.parse(given)
        return
    found = filters.parse(given)
    rows = [("", "", found.floor), *((x.target, ",".join(f"{k}={v}" for k, v in x.labels), x.level) for x in found.directives)]
    assert sorted(rows) == sorted(FILTERS[given])


def test_settings_and_their_ranges():
    s = config.from_yaml(YAML, {"RATE": "0.25", "OBS_SAMPLING__TAIL_BUFFER_CAPACITY": "16", "OTHER_FILTER": "x"}, "obs")
    assert (s.filter, s.sampling.default_rate, s.sampling.tail_buffer_capacity) == ("warn", 0.25, 16)
    assert (s.limits.max_payload_bytes, s.limits.max_label_value_bytes) == (512, 1024)
    assert sorted(config.violations(s)) == ["limits.max_payload_bytes", "sampling.per_event.c.d"]


def test_bad_schemas_break_their_rules(spark):
    found = {tuple(r) for r in governance.lint(schemas.field_table(spark, schemas.BAD)).collect()}
    expected = {("ObsEmpty", None, "L009"), ("Unprefixed", None, "L011"), ("ObsLabels", "user", "L001"), ("ObsLabels", "email", "L002"), ("ObsSecret", "api_key", "L003"), ("ObsSecret", "took", "L004")}
    expected |= {("ObsAudit", "mail", "L006"), ("ObsAudit", "CamelCase", "L007"), ("ObsSlots", "payload", "L012"), ("ObsSlots", "trace", "L014"), ("ObsSlots", "span_id", "L014")}
    assert found == {(f"bad.v1.{e}", f, r) for e, f, r in expected}
    assert [tuple(r) for r in governance.label_conflicts(schemas.field_table(spark, schemas.BAD)).collect()] == [("status", 2)]


def test_schema_versions_differ(spark):
    found = {tuple(r) for r in governance.diff(schemas.field_table(spark, schemas.BASE), schemas.field_table(spark, schemas.HEAD)).collect()}
    changes = {("ObsA", 1, "kind", "BREAKING"), ("ObsA", 2, "cardinality", "BREAKING"), ("ObsA", 3, "class", "BREAKING"), ("ObsA", 4, "field removed", "BREAKING"), ("ObsA", 5, "field added", "OK")}
    changes |= {("ObsB", None, "event removed", "BREAKING"), ("ObsC", None, "event added", "NEW")}
    assert found == {(f"app.v1.{e}", t, c, v) for e, t, c, v in changes}


def test_the_catalogue(spark):
    fields = schemas.field_table(spark, schemas.SCHEMAS).groupBy("event").count()
    assert {r["event"]: r["count"] for r in fields.collect()} == {s.full_name: 2 for s in schemas.SCHEMAS}


def test_ddl_and_schema_text(spark):
    schema = spark.createDataFrame([], "full_name string, ts_ns bigint, service string, date string").schema
    assert tables.ddl(schema, "lake.events") == "CREATE TABLE IF NOT EXISTS lake.events (\n  `full_name` string,\n  `ts_ns` bigint,\n  `service` string,\n  `date` string\n) USING parquet PARTITIONED BY (service, date)"
    assert tables.schema_json(schema) == tables.schema_json(type(schema).fromJson(schema.jsonValue()))


def test_digest_ids_keep_parts_apart(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("", None), (None, "")], "x string, y string")
    ids = [r[0] for r in df.select(text.digest_id(F.col("x"), F.col("y"))).collect()]
    assert ids[0] != ids[1] and ids[2] == ids[3] and all(len(i) == 16 for i in ids)


def test_metric_bounds(spark):
    points = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", float("nan")), ("a", None), ("b", 5.0), (None, 1.0)], "m string, v double")
    declared = spark.createDataFrame([("a", [2.0, 1.0, None]), ("a", [1.0, 2.0, 2.0]), ("c", [9.0]), (None, [1.0])], "metric string, bounds array<double>")
    found = {r["m"]: (r["bounds"], r["buckets"], r["n"]) for r in metrics.metric_histograms(points, ["m"], "m", "v", declared).collect()}
    assert found == {"a": ([1.0, 2.0], [1, 2], 3), "b": ([], [], 1), None: ([], [], 1)}
    with pytest.raises(ValueError, match="different bounds"):
        metrics.metric_histograms(points, ["m"], "m", "v", declared.union(spark.createDataFrame([("a", [3.0])], declared.schema)))
    assert metrics.metric_histograms(points.limit(0), ["m"], "m", "v", declared.limit(0)).collect() == []
