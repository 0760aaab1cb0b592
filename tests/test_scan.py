"""Prefix scans and greedy limits against plain loops, with hot keys cut into many chunks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.operators import dimensions, limits, scan, spans


def _rows(seed, n=4000, hot=0.5, step=40):
    """(key, ts, id, v): one key with ``hot`` of all rows, ties in time, a null key."""
    rng = np.random.default_rng(seed)
    keys = [None if k == 3 else "hot" if u < hot else f"k{k}" for k, u in zip(rng.integers(0, 40, n).tolist(), rng.random(n).tolist(), strict=True)]
    return [(k, int(t), i, int(v)) for i, (k, t, v) in enumerate(zip(keys, np.cumsum(rng.integers(0, 3, n)) * step, rng.integers(-5, 9, n), strict=True))]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(1), "key string, ts long, id long, v long").repartition(7).cache()


def _by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("parts,least", [(16, 1), (2, 1), (16, None)])
def test_running_values_equal_a_loop(table, parts, least):
    s = scan.Scan(table, ["key"], ["ts", "id"], parts, least)
    assert s.hot == (least == 1 and parts > 2)
    got = s.running(s.rows, {"n": ("sum", F.lit(1).cast("long")), "total": ("sum", F.col("v")), "most": ("max", F.col("v")), "low": ("min", F.struct("v", "id"))})
    found = {r.id: (r.n, r.total, r.most, r.low and tuple(r.low)) for r in got.collect()}
    for rows in _by_key([tuple(r) for r in table.collect()]).values():
        for i, r in enumerate(rows):
            before = rows[:i]
            want = (i, sum(x[3] for x in before), max((x[3] for x in before), default=None), min(((x[3], x[2]) for x in before), default=None))
            assert found[r[2]] == want


def test_a_hot_key_is_spread(table):
    s = scan.Scan(table, ["key"], ["ts", "id"], 16, 1)
    sizes = {(r.key, r._chunk): r["count"] for r in s.rows.groupBy("key", "_chunk").count().collect()}
    assert max(sizes.values()) < 4000 / 16 * 2 and sum(1 for k, _ in sizes if k == "hot") >= 6


def test_one_time_for_all_rows_is_cut_by_the_second_column(spark):
    df = spark.range(5000).select(F.lit("a").alias("key"), F.lit(7).alias("ts"), "id")
    got = scan.numbered(df, ["key"], ["ts", "id"], "nth", 8, 1).collect()
    assert sorted((r.id, r.nth) for r in got) == [(i, i + 1) for i in range(5000)]
    assert scan.Scan(df, ["key"], ["ts", "id"], 8, 1).rows.select("_chunk").distinct().count() >= 5


def test_places_of_a_whole_table(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("x"))
    got = sorted((r.x, r.nth) for r in scan.numbered(df, [], ["x"], "nth", 10, 1).collect())
    assert [n for _, n in got] == list(range(1, 3001))
    assert scan.numbered(df.limit(0), [], ["x"], "nth").collect() == []


def _debounce(rows, gap):
    out = set()
    for mine in _by_key(rows).values():
        last = None
        for r in mine:
            if last is None or r[1] - last >= gap:
                last = r[1]
                out.add(r[2])
    return out


def _bucket(rows, token, burst):
    out = set()
    for mine in _by_key(rows).values():
        held, last = burst * token, mine[0][1]
        for r in mine:
            held, last = min(burst * token, held + r[1] - last), r[1]
            if held >= token:
                held -= token
                out.add(r[2])
    return out


def _no_python(df):
    plan = df._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" not in plan and "InPandas" not in plan


@pytest.mark.parametrize("seed,gap", [(1, 1), (1, 40), (2, 700)])
def test_debounce_equals_a_loop(spark, seed, gap):
    rows = _rows(seed, 900, step=10**6)
    df = spark.createDataFrame(rows, "key string, ts long, id long, v long")
    got = limits.debounced(df, "key", "ts", "id", gap, 8, 1)
    _no_python(got)
    assert {r.id for r in got.where("admitted").collect()} == _debounce(rows, gap * 10**6) and got.count() == len(rows)


@pytest.mark.parametrize("seed,token,burst", [(1, 100, 5), (2, 63, 1), (3, 90, 3)])
def test_token_bucket_equals_a_loop(spark, seed, token, burst):
    rows = _rows(seed, 900)
    df = spark.createDataFrame(rows, "key string, ts long, id long, v long")
    got = limits.token_bucket(df, "key", "ts", "id", 1e9 / token, burst, 8, 1)
    _no_python(got)
    assert {r.id for r in got.where("admitted").collect()} == _bucket(rows, token, burst) and got.count() == len(rows)


def test_limits_of_an_empty_table(spark):
    none = spark.createDataFrame([], "key string, ts long, id long")
    assert limits.debounced(none, "key", "ts", "id").collect() == [] and limits.token_bucket(none, "key", "ts", "id").collect() == []


def test_pairs_of_a_hot_key_equal_a_fold(spark):
    rows = _rows(6)
    df = spark.createDataFrame(rows, "key string, ts long, id long, v long")
    got = spans.completed_spans(spans.paired(df, "key", F.col("v") < 2, F.col("v") >= 5, 200, "ts", "id", 16, 1)).collect()
    want = set()
    for mine in _by_key(rows).values():
        open_ = None
        for r in mine:
            if r[3] < 2:
                open_ = r
            elif r[3] >= 5:
                want.add((r[0], r[2], open_[2] if open_ and r[1] - open_[1] <= 200 else None))
                open_ = None
    assert {(r.key, r.end_id, r.start_id) for r in got} == want


def test_registrations_of_a_hot_callsite(spark):
    rows = [r for r in _rows(7) if r[0] is not None]
    df = spark.createDataFrame(rows, "key string, ts long, id long, v long")
    got = {r.id for r in dimensions.registrations(df, "key", "ts", "id", 50, 60_000, 16, 1).collect()}
    want = {r[2] for mine in _by_key(rows).values() for i, r in enumerate(mine) if r[1] - mine[0][1] >= 60_000 or i % 50 == 0}
    assert got == want
