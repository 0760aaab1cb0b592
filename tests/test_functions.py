"""The filter language, the scalar functions and the wire forms."""

import random

import pytest
from pyspark.sql import functions as F

from eventloom.functions import filters, text, wire


@pytest.mark.parametrize("bad", ["info,a=BOGUS", "a[route=x=info", "a[k]=info", "a b=info"])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        filters.parse(bad)


def test_filters_parse():
    f = filters.parse('warn, a.b[route="/u,[1]",k=v]=DEBUG,a=off,c::d')
    assert f.floor == 4
    assert f.dynamic == [filters.Directive("a.b", (("route", "/u,[1]"), ("k", "v")), 2)]
    assert [(d.target, d.level) for d in f.static] == [("c::d", 1), ("a", 0)]
    assert filters.label_keys(f) == [("a.b", "k"), ("a.b", "route")]


CASES = [
    ("info,app.v1.A[route=admin]=trace", "app.v1.A", {"route": "admin"}, 1, True),
    ("info,app.v1.A[route=admin]=trace", "app.v1.A", {"route": "users"}, 1, False),
    ("off", "app.v1.A", {}, 5, False),
    ("warn,app=debug", "app.v1.A", {}, 2, True),
    ("warn,app=debug", "apple.v1.A", {}, 2, False),
    ("app=debug,app.v1=off", "app.v1.A", {}, 6, False),
    ("app.v1.A[x=1]=off", "app.v1.A", None, 4, True),
]


@pytest.mark.parametrize(("rules", "name", "labels", "rank", "expected"), CASES)
def test_filters_decide(spark, rules, name, labels, rank, expected):
    df = spark.createDataFrame([(name, labels, rank)], "full_name string, labels map<string,string>, sev_rank int")
    assert df.select(filters.allowed(rules)).first()[0] is expected


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (text.counter_name, "foo", "foo_total"), (text.counter_name, "foo.count", "foo_total"), (text.counter_name, "foo_counter", "foo_total"),
        (text.metric_name, "9a-b.c", "_a_b_c"), (text.label_escape, 'a"b\\c\nd', 'a\\"b\\\\c\\nd'), (text.payload_column, "App.v1.Ev", "payload_app_v1_ev"),
        (text.snake_case, "latencyMs", "latency_ms"), (lambda c: text.cap_bytes(c, 5), "aéééz", "aéé…<truncated:8>"), (lambda c: text.cap_bytes(c, 5), "abc", "abc"),
        (lambda c: text.traceparent(c)["sampled"], "00-" + "a" * 32 + "-" + "b" * 16 + "-03", True), (lambda c: text.traceparent(c)["sampled"], "00-zz", None),
    ],
)
def test_text_functions(spark, f, value, expected):
    assert one(spark, f(F.col("v")), value) == expected


def test_null_texts_stay_null(spark):
    for f in (text.metric_name, text.label_escape, lambda c: text.cap_bytes(c, 3), text.snake_case):
        assert one(spark, f(F.col("v")), None) is None


@pytest.mark.parametrize(("value", "expected"), [(3.0, "3"), (2.5, "2.5"), (float("inf"), "+Inf"), (float("nan"), "NaN")])
def test_float_text(spark, value, expected):
    assert one(spark, text.float_text(F.col("v")), value, "double") == expected


def test_times_are_exact(spark):
    assert one(spark, text.rfc3339(F.col("v")), 1704360798696208999, "long") == "2024-01-04T09:33:18.696208Z"
    assert tuple(one(spark, text.date_hour(F.col("v")), 1777731600000000000, "long")) == ("2026-05-02", 14)
    with pytest.raises(ValueError):
        text.duration_ns("5 weeks")


def test_redaction(spark):
    got = one(spark, text.redact_map(F.create_map(F.lit("User_Password"), F.col("v"), F.lit("route"), F.lit("/x"))), "hunter2")
    assert got == {"User_Password": text.REDACTED, "route": "/x"}


def test_hashes():
    assert wire.crc32c(b"123456789") == 0xE3069283
    assert wire.blake3(b"").hex().startswith("af1349b9f5f9a1a6")
    assert wire.blake3(bytes(i % 251 for i in range(1025))).hex().startswith("d00278ae47eb27b3")


def test_bytes_never_crash():
    draw = random.Random(7)
    good = wire.encode_envelope({"full_name": "a.b", "ts_ns": 5, "labels": {"k": "v"}, "payload": b"\x08\x01"})
    assert wire.decode_envelope(good)["labels"] == {"k": "v"}
    for _ in range(500):
        data = bytearray(good)
        for _ in range(draw.randint(1, 4)):
            data[draw.randrange(len(data))] = draw.randrange(256)
        try:
            wire.decode_envelope(bytes(data[: draw.randint(0, len(data))]))
        except (ValueError, AttributeError, TypeError):
            continue


def test_bad_tails_are_dropped(spark):
    frames = [wire.encode_envelope({"full_name": n}) for n in ("a", "b")]
    cut = wire.joined(frames, "records")[:-1]
    df = spark.createDataFrame([(bytearray(cut),), (None,), (bytearray(b""),)], "data binary")
    assert [r.full_name for r in wire.decoded(df, "data", "records").collect()] == ["a"]
