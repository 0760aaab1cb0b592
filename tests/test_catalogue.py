"""Each query of the catalogue against its SQL, and the folds against a plain loop."""

import pytest

from eventloom import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def _events(spark, sf):
    from eventloom.functions.envelope import from_events

    return from_events(spark.read.parquet(f"{sf}/events.parquet"))


def test_folds_equal_loops(spark, sf):
    rows = sorted(_events(spark, sf).select("user_id", "ts_ns", "event_id").collect())
    held, tokens, last, bucket, quiet = None, 0.0, 0, set(), set()
    accepted = None
    for user, ts, event in rows:
        if user != held:
            held, tokens, last, accepted = user, 5.0, ts, None
        tokens = min(5.0, tokens + (ts - last) / 1e9 / 86400)
        last = ts
        if tokens >= 1:
            tokens -= 1
            bucket.add((user, event))
        if accepted is None or ts - accepted >= 6 * 3600 * 10**9:
            accepted = ts
            quiet.add((user, event))
    for name, expected in (("wn04_token_bucket", bucket), ("wn05_debounce", quiet)):
        assert {tuple(r) for r in catalog.QUERIES[name](spark, sf).select("user_id", "event_id").collect()} == expected


def test_pairs_equal_a_fold(spark, sf):
    from pyspark.sql import functions as F

    e = _events(spark, sf)
    rows = sorted(e.where("full_name in ('shop.v1.ObsView', 'shop.v1.ObsPurchase')").select("user_id", "ts_ns", "event_id", "full_name").collect())
    pending, expected = {}, set()
    for user, ts, event, name in rows:
        if name.endswith("View"):
            pending[user] = (ts, event)
        else:
            s = pending.pop(user, None)
            expected.add((user, event, s[1] if s and ts - s[0] <= 24 * 3600 * 10**9 else None))
    found = catalog.QUERIES["jn03_span_pairs"](spark, sf).select("user_id", "end_id", "start_id")
    assert {tuple(r) for r in found.collect()} == expected
    assert F is not None


def test_partitions_are_pruned(spark, sf, tmp_path):
    from eventloom.sinks import tables

    tables.write(_events(spark, sf), str(tmp_path / "t"))
    plan = tables.read(spark, str(tmp_path / "t")).where("service = 'web'").select("k")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(service" in plan and "props" not in plan.split("ReadSchema")[-1]


@pytest.mark.parametrize("name", ["m0_filtered_volume", "wn01_error_tail", "jn03_span_pairs", "ag06_promotion_cap", "fl15_head_sampler"])
def test_empty_tables(name, spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).collect() == []
