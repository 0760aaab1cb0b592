"""Scalar functions over Columns: names, numbers, times, ids, caps and redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A field whose lower-cased name contains one of these is redacted.
PRIVATE_NAMES = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "api-key",
    "authorization", "cookie", "ssn", "credit_card", "credit-card", "creditcard", "bearer",
)
REDACTED = "[REDACTED:bridge_pattern]"
_UNITS = {"ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}


def metric_name(c: Column) -> Column:
    """Other characters than letters, digits, ``_`` and ``:`` become ``_``; no leading digit."""
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9_:]", "_"), "^[0-9]", "_")


def counter_name(c: Column) -> Column:
    """A metric name that ends in ``_total`` in place of ``_count`` or ``_counter``."""
    bare = F.regexp_replace(metric_name(c), "_(count|counter)$", "")
    return F.when(bare.endswith("_total"), bare).otherwise(F.concat(bare, F.lit("_total")))


def label_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def float_text(c: Column) -> Column:
    """Whole numbers under 1e16 without decimals; NaN, +Inf and -Inf by name."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e16)
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "+Inf").when(c == float("-inf"), "-Inf").when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


def cap_bytes(c: Column, most: int) -> Column:
    """At most ``most`` UTF-8 bytes, cut between characters, and a note of the full size."""
    raw = F.encode(c, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, most - i).cast("string")) for i in range(4) if most >= i]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.concat(F.coalesce(*cuts, F.lit("")), F.lit("…<truncated:"), F.octet_length(c).cast("string"), F.lit(">")))


def is_snake_case(c: Column) -> Column:
    return F.coalesce(c.rlike("^[a-z][a-z0-9_]*$"), F.lit(False))


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_"))


def payload_column(c: Column) -> Column:
    return F.concat(F.lit("payload_"), F.lower(F.replace(c, F.lit("."), F.lit("_"))))


def status_class(status: Column) -> Column:
    return F.when(status.between(100, 599), F.concat(F.floor(status / 100).cast("string"), F.lit("xx"))).otherwise("err")


def traceparent(c: Column) -> Column:
    """(trace_id, span_id, sampled) of a version 00 header, null if it isn't well formed."""
    shape = "^00-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})$"
    flags = F.conv(F.regexp_extract(c, shape, 3), 16, 10).cast("int")
    found = F.struct(F.regexp_extract(c, shape, 1).alias("trace_id"), F.regexp_extract(c, shape, 2).alias("span_id"), (flags.bitwiseAND(1) == 1).alias("sampled"))
    return F.when(c.rlike(shape) & ~c.rlike("^00-0{32}|^00-.{32}-0{16}"), found)


def render_traceparent(trace_id: Column, span_id: Column, sampled: Column) -> Column:
    return F.concat(F.lit("00-"), F.lpad(trace_id, 32, "0"), F.lit("-"), F.lpad(span_id, 16, "0"), F.when(sampled, "-01").otherwise("-00"))


def fresh_ids(key: Column) -> Column:
    """A trace id and a span id that follow from ``key``."""
    return F.struct(F.md5(key).alias("trace_id"), F.substring(F.md5(F.concat(key, F.lit("/span"))), 1, 16).alias("span_id"))


def whole(c: Column, by: int) -> Column:
    """``c`` divided by ``by`` and rounded down, exact for all longs."""
    return ((c - F.pmod(c, F.lit(by))).cast("decimal(20,0)") / by).cast("long")


def date_hour(ts_ns: Column) -> Column:
    """UTC date and hour; times before 1970 count as 1970."""
    seconds = F.greatest(whole(ts_ns, 10**9), F.lit(0))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))
    return F.struct(day.cast("string").alias("date"), (F.floor(seconds / 3600) % 24).cast("int").alias("hour"))


def rfc3339(ts_ns: Column) -> Column:
    """UTC time to the microsecond, independent of the session's zone."""
    us = whole(ts_ns, 1000)
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (us.cast("decimal(24,6)") / 1000000).cast("decimal(18,6)"))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def duration_ns(text: str) -> int:
    """Nanoseconds of ``250ms``, ``5s``, ``10m``, ``2h`` or ``1d``; ValueError for other texts."""
    m = re.fullmatch(r"\s*(\d+)\s*(ms|s|m|h|d)\s*", text)
    if not m:
        raise ValueError(f"not a duration: {text!r}")
    return int(m[1]) * _UNITS[m[2]]


def duration_column(c: Column) -> Column:
    """The nanoseconds of a column of duration literals; null for other texts and for more than a long holds."""
    of = lambda i: F.regexp_extract(c, r"^\s*(\d{1,18})\s*(ms|s|m|h|d)\s*$", i)
    unit = F.create_map(*(F.lit(x) for pair in _UNITS.items() for x in pair))
    return F.try_multiply(of(1).try_cast("long"), F.try_element_at(unit, of(2)).cast("long"))


def digest_id(*parts: Column) -> Column:
    """A 64-bit id as 16 hex digits: the first eight bytes of the SHA-256 of the parts, each after its length.

    Null parts count as empty; the lengths keep ``a, bc`` and ``ab, c`` apart.  The id zero stands
    for no id, so a hash of zero becomes one.
    """
    own = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    framed = F.concat(*(x for p in own for x in (F.octet_length(p).cast("string"), F.lit(":"), p)))
    head = F.substring(F.sha2(framed, 256), 1, 16)
    return F.when(head == "0" * 16, "0" * 15 + "1").otherwise(head)


def hash_unit(key: Column) -> Column:
    """A number from 0 to below 1 that follows from ``key``."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 4294967296.0


def hex_bytes(c: Column, size: int) -> Column:
    """Bytes of a hex text, padded with zeros at the end; zeros for what isn't hex."""
    return F.unhex(F.when(c.rlike(f"^[0-9A-Fa-f]{{0,{2 * size}}}$") & (F.length(c) % 2 == 0), F.rpad(c, 2 * size, "0")).otherwise("0" * (2 * size)))


def redact_map(fields: Column) -> Column:
    """Map values under private-looking names replaced by a marker."""
    private = "|".join(re.escape(x) for x in PRIVATE_NAMES)
    return F.transform_values(fields, lambda k, v: F.when(F.lower(k).rlike(private), F.lit(REDACTED)).otherwise(v))


def scrub(value: Column, name: str, classification: str, is_text: bool) -> Column:
    """Classified texts become ``<redacted-name>``, other classified values null."""
    if classification not in ("PII", "SECRET"):
        return value
    return F.when(value.isNotNull(), F.lit(f"<redacted-{name}>")) if is_text else F.lit(None).cast("string")


def backoff_ms(attempt: Column, first: int = 1000, factor: float = 2.0, most: int = 30000) -> Column:
    return F.least(F.lit(float(first)) * F.pow(F.lit(factor), attempt - 1), F.lit(float(most))).cast("long")


def resource_slots(attributes: Column) -> Column:
    """Known resource keys and the rest of a ``k=v,k=v`` list; usual names for machine types."""
    every = F.str_to_map(attributes, F.lit(","), F.lit("="))
    arch = every["host.arch"]
    known = ["service.namespace", "deployment.environment", "host.name", "host.arch"]
    return F.struct(
        every["service.namespace"].alias("service_namespace"),
        every["deployment.environment"].alias("environment"),
        every["host.name"].alias("host_name"),
        F.when(arch == "x86_64", "amd64").when(arch == "aarch64", "arm64").otherwise(arch).alias("host_arch"),
        F.map_filter(every, lambda k, v: ~k.isin(known)).alias("extra"),
    )


def quoted_fields(labels: Column) -> Column:
    """``k=v`` separated by blanks, by key; values with blanks or ``="{}`` are quoted."""
    def one(e):
        v = e["value"]
        inner = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(e["key"], F.lit("="), F.when((v == "") | v.rlike(r'[\s="{}]'), F.concat(F.lit('"'), inner, F.lit('"'))).otherwise(v))

    return F.array_join(F.transform(F.array_sort(F.map_entries(labels)), one), " ")


def child_ids(trace_id: Column, span_id: Column, key: Column) -> Column:
    """Ids of a child span: the parent's trace, a span id that follows from ``key``, the parent's span."""
    return F.struct(trace_id.alias("trace_id"), F.substring(F.md5(F.concat(key, F.lit("/span"))), 1, 16).alias("span_id"), span_id.alias("parent_span_id"))


def short(c: Column, most: int) -> Column:
    """At most ``most`` characters: reasons have 512, debug keys 128."""
    return F.left(c, F.lit(most))


def time_or_now(ts_ns: Column, now_ns: int) -> Column:
    """Zero or missing times become ``now_ns``."""
    return F.coalesce(F.nullif(ts_ns, F.lit(0).cast("long")), F.lit(now_ns))


def partition_hex(key: Column, digits: int = 16) -> Column:
    """A short hex name of a partition's key."""
    return F.substring(F.sha2(key, 256), 1, digits)


def path_text(names: Column, between: str = ":") -> Column:
    """Names of open spans from the outermost in: ``:`` in scopes, ``.`` in log bridges."""
    return F.array_join(names, between)


def word_of(c: Column, words: tuple[str, ...], prefix: str = "") -> Column:
    """The one of ``words`` that a text names in any case, with or without ``prefix``; else null."""
    name = F.regexp_replace(F.upper(F.trim(c)), f"^{prefix}", "") if prefix else F.upper(F.trim(c))
    return F.when(name.isin(list(words)), name)


def unique_labels(pairs: Column) -> Column:
    """A map of an array of (key, value): sorted, and of equal keys the first."""
    ordered = F.array_sort(pairs)
    first = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ordered, i - 1)["key"] != x["key"]))
    return F.map_from_entries(first)
