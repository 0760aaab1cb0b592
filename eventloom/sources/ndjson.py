"""Newline-delimited JSON: tolerant scan and the event query over envelopes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.envelope import sev_rank, severity_name
from eventloom.functions.text import duration_ns
from eventloom.sources import growing

LINE = "ts_ns long, full_name string, sev string, tier string, service string, trace_id string, span_id string, labels map<string,string>, payload string"


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """Envelopes from lines; blank, malformed and foreign lines give no row."""
    one = F.from_json(F.col(column), LINE, {"mode": "PERMISSIVE"})
    rows = lines.where(F.trim(F.col(column)) != "").select(one.alias("e")).where("e.full_name is not null").select("e.*")
    return rows.withColumn("sev_rank", F.coalesce(sev_rank(severity_name(F.col("sev"))), F.lit(3)))


def scan(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def follow(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the envelopes in a folder of growing files: new files, and lines that are appended to old ones.

    A file that shrinks is read anew (``growing``).
    """
    return parse(growing.lines(spark, path))


def query(
    envelopes: DataFrame,
    events: list[str] | None = None,
    severity: str | None = None,
    labels: dict[str, str] | None = None,
    since: str | None = None,
    until_ns: int | None = None,
    now_ns: int | None = None,
    trace: str | None = None,
    grep: tuple[str, str] | None = None,
    select: list[str] | None = None,
    order_by: list[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Envelopes that meet every given condition; all conditions reach the scan.

    ``since`` is a duration before ``now_ns``; ``grep`` a column and a text it holds.
    A limit needs an order; unknown severities and durations raise ValueError.
    """
    tests: list[Column] = []
    if events:
        tests.append(F.col("full_name").isin(events))
    if severity:
        from eventloom.functions.filters import level

        if not (rank := level(severity)):
            raise ValueError(f"unknown severity {severity!r}")
        tests.append(F.col("sev_rank") >= rank)
    tests += [F.coalesce(F.col("labels")[k] == v, F.lit(False)) for k, v in (labels or {}).items()]
    if since:
        if now_ns is None:
            raise ValueError("since needs now_ns")
        tests.append(F.col("ts_ns") >= now_ns - duration_ns(since))
    if until_ns is not None:
        tests.append(F.col("ts_ns") < until_ns)
    if trace:
        tests.append(F.col("trace_id") == trace)
    if grep:
        tests.append(F.coalesce(F.col(grep[0]).contains(grep[1]), F.lit(False)))
    found = envelopes.where(reduce(lambda a, b: a & b, tests)) if tests else envelopes
    if limit is not None and not order_by:
        raise ValueError("a limit needs order_by")
    if order_by:
        found = found.orderBy(*(F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by))
    found = found.limit(limit) if limit is not None else found
    return found.select(*select) if select else found
