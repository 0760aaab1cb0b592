"""Streams in several micro-batches against the batch result: timers, growing files, observed counters."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.catalog import ORACLE, QUERIES
from eventloom.operators import counting
from eventloom.sources import growing, ndjson
from eventloom.streaming import timers

SECOND = 10**9


class Feed:
    """A folder of files that a stream is drained from, a batch at a time, with one checkpoint."""

    def __init__(self, spark, tmp_path, schema, make):
        self.spark, self.at, self.schema, self.make = spark, tmp_path, schema, make
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        self.n = 0

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.at}/in")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.at}/in")
        with timers.rocksdb(self.spark):
            q = self.make(stream).writeStream.format("parquet").option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start(f"{self.at}/out")
            q.awaitTermination()
        return [tuple(r) for r in self.spark.read.parquet(f"{self.at}/out").collect()]


_ROWS = "key string, ts_ns long, id long, kind string"


def test_orphans_leave_by_timer_and_later_starts_overwrite(spark, tmp_path):
    feed = Feed(spark, tmp_path, _ROWS, lambda s: timers.pairs(s, "key", 60 * SECOND, "10 seconds"))
    assert feed.put([("a", 1, 1, "start"), ("b", SECOND, 2, "start"), ("a", 5 * SECOND, 3, "start")]) == []
    # out of order: the end of a comes before a start that is younger, in the same key
    got = feed.put([("a", 9 * SECOND, 5, "end"), ("a", 7 * SECOND, 4, "start"), ("c", 40 * SECOND, 6, "end"), ("x", 60 * SECOND, 7, "start")])
    assert set(got) == {("a", "completed", 7 * SECOND, 4, 9 * SECOND, 5), ("c", "completed", None, None, 40 * SECOND, 6)}
    got = feed.put([("x", 100 * SECOND, 8, "start")])
    assert set(got[2:]) | set(got) >= {("b", "orphan", SECOND, 2, None, None)} and len(got) == 3
    # x was overwritten in time; its second start is an orphan when the watermark has passed it
    got = feed.put([("y", 500 * SECOND, 9, "end")])
    assert ("x", "orphan", 100 * SECOND, 8, None, None) in got and not any(r[3] == 7 for r in got)


def _fold(rows, timeout):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for key, mine in by.items():
        held = None
        for _, ts, i, kind in sorted(mine, key=lambda r: (r[1], r[2])):
            if held and ts - held[0] > timeout:
                out.append((key, "orphan", *held, None, None))
                held = None
            if kind == "start":
                held = (ts, i)
            else:
                out.append((key, "completed", *(held or (None, None)), ts, i))
                held = None
        if held:
            out.append((key, "orphan", *held, None, None))
    return out


def test_many_batches_equal_a_fold(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"k{rng.integers(0, 9)}", int((i + 9) * SECOND + rng.integers(-4, 5) * SECOND), i, "end" if rng.random() < 0.4 else "start") for i in range(240)]
    feed = Feed(spark, tmp_path, _ROWS, lambda s: timers.pairs(s, "key", 20 * SECOND, "30 seconds"))
    for k in range(0, 240, 80):
        feed.put(rows[k : k + 80])
    got = feed.put([("z", 10**6 * SECOND, 999, "start")])
    assert sorted(map(repr, got)) == sorted(map(repr, _fold(rows, 20 * SECOND)))


def test_series_expire(spark, tmp_path):
    feed = Feed(spark, tmp_path, "key string, ts_ns long, id long", lambda s: timers.expiring_series(s, "key", 30 * SECOND, "1 second"))
    assert feed.put([("a", SECOND, 1), ("a", 31 * SECOND, 2), ("b", 10 * SECOND, 3)]) == []
    assert set(feed.put([("a", 70 * SECOND, 4)])) == {("b", 10 * SECOND, 10 * SECOND, 1), ("a", SECOND, 31 * SECOND, 2)}
    assert ("a", 70 * SECOND, 70 * SECOND, 1) in feed.put([("c", 200 * SECOND, 5)])


def test_a_key_has_one_timer_for_all_rows_that_wait(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(None if i % 50 == 0 else f"k{i % 7}", int(rng.integers(1, 3000)) * SECOND + int(rng.integers(0, 2)), i) for i in range(700)]
    spark.createDataFrame([*rows, ("z", 10**6 * SECOND, 700)], "key string, ts_ns long, id long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts_ns long, id long").parquet(f"{tmp_path}/in")
    with timers.rocksdb(spark):
        made = timers.expiring_series(stream, "key", 10 * SECOND, "1 second")
        q = made.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    series = {}
    for key, ts, _ in sorted(rows, key=lambda r: r[1]):
        mine = series.setdefault(key, [])
        if mine and ts - mine[-1][1] <= 10 * SECOND:
            mine[-1][1:] = ts, mine[-1][2] + 1
        else:
            mine.append([ts, ts, 1])
    assert sorted(map(repr, (tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()))) == sorted(repr((k, *x)) for k, v in series.items() for x in v)
    assert sum(p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in q.recentProgress if p.stateOperators) <= 2 * 9  # 8 keys and z


def test_series_of_unknown_and_negative_users(spark, sf, duck, tmp_path):
    user = F.when(F.col("user_id") % 5 > 1, F.col("user_id")).when(F.col("user_id") % 5 == 1, -F.col("user_id"))
    spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", user).write.parquet(f"{tmp_path}/events.parquet")
    with duck.cursor() as own:
        own.execute(f"CREATE TEMP VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
        want = own.execute(ORACLE["sr09_stream_expiry"]).fetchall()
    got = QUERIES["sr09_stream_expiry"](spark, str(tmp_path)).select("user_id", "first_ns", "last_ns", "n").collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want)) and any(r.user_id is None for r in got)


def _follow(spark, at, out):
    q = growing.lines(spark, f"{at}", split=40).writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(str(out))
    q.awaitTermination()
    return sorted(r.value for r in spark.read.schema("value string").parquet(str(out)).collect())


def test_appended_lines_come_once_and_truncated_files_start_over(spark, tmp_path):
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    first = [f"line {i} " + "x" * (i % 60) for i in range(50)]
    (folder / "a.log").write_text("\n".join(first) + "\nhalf a li")
    (folder / ".hidden").write_text("not read\n")
    (folder / "empty.log").write_text("")
    assert _follow(spark, folder, out) == sorted(first)
    with (folder / "a.log").open("a") as f:
        f.write("ne\nnext é\r\n")
    (folder / "b.log").write_text("b1\nb2\n")
    seen = sorted([*first, "half a line", "next é", "b1", "b2"])
    assert _follow(spark, folder, out) == seen
    assert _follow(spark, folder, out) == seen  # nothing new
    (folder / "a.log").write_text("anew\n")  # truncated
    assert _follow(spark, folder, out) == sorted([*seen, "anew"])
    with (folder / "a.log").open("a") as f:
        f.write("and on\n")
    assert _follow(spark, folder, out) == sorted([*seen, "anew", "and on"])


@pytest.mark.parametrize("split", [1, 2, 3, 7, 1000])
@pytest.mark.parametrize("text", ["a\nbb\nccc\n\ndddd\n", "\n\n\n", "one line\n", "no end", "ab\ncd"])
def test_parts_of_a_file_have_each_line_once(tmp_path, split, text, monkeypatch):
    monkeypatch.setattr(growing, "_READ", 4)
    (tmp_path / "f").write_text(text)
    reader = growing.GrowingReader(str(tmp_path), split)
    parts = reader.partitions({}, reader.latestOffset())
    got = [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert got == text[: text.rfind("\n") + 1].split("\n")[:-1]


def test_followed_envelopes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_text('{"full_name":"x.Y","sev":"warn","ts_ns":5}\n\n{bad\n')
    q = ndjson.follow(spark, f"{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start(f"{tmp_path}/o")
    q.awaitTermination()
    assert [(r.full_name, r.sev_rank) for r in spark.read.parquet(f"{tmp_path}/o").collect()] == [("x.Y", 4)]


def test_counters_come_with_the_write(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").otherwise(F.lit(None)).alias("tier"))
    kept, out = F.col("id") < 50, f"{tmp_path}/o"
    seen = counting.counted_write(df, kept, counting.delivered_and_dropped(kept, F.col("tier"), ["a", "b"]), lambda rows: rows.write.parquet(out))
    assert seen == {"delivered_a": 13, "delivered_b": 13, "delivered_other": 24, "dropped_a": 12, "dropped_b": 12, "dropped_other": 26}
    assert spark.read.parquet(out).count() == 50


def test_counters_of_a_stream(spark, tmp_path):
    spark.range(30).repartition(3).write.parquet(f"{tmp_path}/in")
    listener = counting.StreamCounters("passed")
    spark.streams.addListener(listener)
    try:
        rows = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("passed", F.count_if(F.col("id") < 10).alias("small"), F.count("*").alias("n"))
        q = rows.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start(f"{tmp_path}/o")
        q.awaitTermination()
        for _ in range(100):
            if listener.totals["n"] == 30:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert dict(listener.totals) == {"small": 10, "n": 30}
