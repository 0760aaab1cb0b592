"""Keyed state with timers: rows of a key in event time, whatever order they come in.

``OrderedRows`` holds a key's rows until the watermark has passed them, hands them to a
subclass in the order of their times, and calls it when a deadline of its own passes.  So a
stream gives the rows that the whole table would, in any number of micro-batches, and state
that nothing follows leaves by a timer.  A key has a timer for its first row that waits and
one for its deadline, however many rows it holds.  Times up to 1970 are late for any stream.  These streams need the RocksDB state store
(``rocksdb``).
"""

from __future__ import annotations

import bisect
import itertools
import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from eventloom.functions.text import whole
from eventloom.plans.shipping import ship

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Waiting rows of a key that are kept as one value of its state.
_ROWS = 4096


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _packed(rows: Iterator[Row]) -> Iterator[list[tuple]]:
    """``rows`` as lists of at most ``_ROWS`` places and kinds."""
    while part := [(int(r["ts_ns"]), int(r["id"]), str(r["kind"])) for r in itertools.islice(rows, _ROWS)]:
        yield part


class OrderedRows(StatefulProcessor):
    """Folds a key's rows in event time; a subclass says what a row does and when it has waited enough.

    Input columns: the key, ``ts_ns``, ``id`` and ``kind`` (text).  A row's place is (ts_ns, id).
    Outputs are tuples of the columns after the key.
    """

    def __init__(self, columns: list[str], key: str) -> None:
        self.columns, self.key = columns, key

    # what a subclass gives

    def row(self, held: dict, ts: int, event: int, kind: str) -> Iterator[tuple]:
        """Take one row into ``held`` and give the outputs that follow."""
        raise NotImplementedError

    def deadline(self, held: dict) -> int | None:
        """The last nanosecond at which ``held`` may still be followed by something."""
        raise NotImplementedError

    def overdue(self, held: dict) -> Iterator[tuple]:
        """The deadline has passed: clear ``held`` and give what leaves."""
        raise NotImplementedError

    # Spark's side

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.state = handle.getValueState("held", "value string")

    def _wake(self, ns: int) -> None:
        """A timer for the first watermark after ``ns``."""
        self.handle.registerTimer(ns // 10**6 + 1)

    def handleInputRows(self, key, rows, timerValues):
        firsts = []
        for part in _packed(rows):
            self.waiting.appendValue((json.dumps(part),))
            firsts.append(min(part)[0])
        if firsts:
            self._wake(min(firsts))  # one timer for all: when it expires, the next row that waits gets one
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        upto = timerValues.getCurrentWatermarkInMs() * 10**6
        waiting = sorted(tuple(x) for (part,) in self.waiting.get() for x in json.loads(part))
        found = self.state.get()
        held = json.loads(found[0]) if found else {}
        n = bisect.bisect_left(waiting, (upto,))
        out = []
        for ts, event, kind in waiting[:n]:
            last = self.deadline(held)
            if last is not None and ts > last:
                out += self.overdue(held)
            out += self.row(held, ts, event, kind)
        last = self.deadline(held)
        over = last is not None and last < upto
        if over:
            out += self.overdue(held)
        if n:
            rest = waiting[n:]
            if rest:
                self.waiting.put([(json.dumps(rest[i : i + _ROWS]),) for i in range(0, len(rest), _ROWS)])
                self._wake(rest[0][0])
            else:
                self.waiting.clear()
        if held and (n or over):
            self.state.update((json.dumps(held),))
            self._wake(self.deadline(held))
        elif found and not held:
            self.state.clear()
        for row in out:
            yield Row(**dict(zip([self.key, *self.columns], (key[0], *row), strict=True)))

    def close(self) -> None:
        pass


class Pairs(OrderedRows):
    """Completed rows with the Started before them, and Started rows that nothing completed in time."""

    COLUMNS = "outcome string, start_ns long, start_id long, end_ns long, end_id long"

    def __init__(self, key: str, timeout_ns: int) -> None:
        super().__init__(["outcome", "start_ns", "start_id", "end_ns", "end_id"], key)
        self.timeout_ns = timeout_ns

    def row(self, held, ts, event, kind):
        if kind == "start":  # a later Started overwrites
            held.update(ts=ts, id=event)
            return
        yield ("completed", held.get("ts"), held.get("id"), ts, event)
        held.clear()

    def deadline(self, held):
        return held["ts"] + self.timeout_ns if held else None

    def overdue(self, held):
        yield ("orphan", held["ts"], held["id"], None, None)
        held.clear()


class Series(OrderedRows):
    """A series' life: a row when it has had no point for longer than ``ttl_ns``; later points begin a new one."""

    COLUMNS = "first_ns long, last_ns long, n long"

    def __init__(self, key: str, ttl_ns: int) -> None:
        super().__init__(["first_ns", "last_ns", "n"], key)
        self.ttl_ns = ttl_ns

    def row(self, held, ts, event, kind):
        held.update(first=held.get("first", ts), last=ts, n=held.get("n", 0) + 1)
        yield from ()

    def deadline(self, held):
        return held["last"] + self.ttl_ns if held else None

    def overdue(self, held):
        yield (held["first"], held["last"], held["n"])
        held.clear()


def _timed(stream: DataFrame, late: str) -> DataFrame:
    return stream.withColumn("ts", F.timestamp_micros(whole(F.col("ts_ns"), 1000))).withWatermark("ts", late)


def _folded(stream: DataFrame, key: str, processor: OrderedRows, late: str) -> DataFrame:
    ship(stream.sparkSession)
    kind = stream.schema[key].dataType.simpleString()
    rows = _timed(stream, late).groupBy(key)
    return rows.transformWithState(statefulProcessor=processor, outputStructType=f"`{key}` {kind}, {processor.COLUMNS}", outputMode="append", timeMode="EventTime")


def pairs(stream: DataFrame, key: str, timeout_ns: int = 60 * 10**9, late: str = "10 minutes") -> DataFrame:
    """(key, outcome, start_ns, start_id, end_ns, end_id) of a stream of (key, ts_ns, id, kind ``start`` or ``end``).

    A Completed within ``timeout_ns`` of the Started before it has its start; a Started that
    another overwrites in time leaves no trace; one that waits longer leaves as ``orphan``
    by a timer, though its key is never seen again.
    """
    return _folded(stream, key, Pairs(key, timeout_ns), late)


def expiring_series(stream: DataFrame, key: str, ttl_ns: int, late: str = "10 minutes") -> DataFrame:
    """(key, first_ns, last_ns, n) of each series of a stream of (key, ts_ns, id), once it's idle for longer than ``ttl_ns``."""
    return _folded(stream.withColumn("kind", F.lit("")), key, Series(key, ttl_ns), late)
