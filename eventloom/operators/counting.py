"""Counters of a pass itself: what was delivered and dropped, counted while the rows are written."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def delivered_and_dropped(kept: Column, by: Column, values: list[str]) -> dict[str, Column]:
    """Counters ``delivered_x`` and ``dropped_x`` for each of a few known values of ``by``; others under ``other``."""
    is_ = {**{v: by == v for v in values}, "other": ~F.coalesce(by.isin(values), F.lit(False))}
    some = {f"delivered_{v}": F.count_if(kept & hit) for v, hit in is_.items()}
    return {**some, **{f"dropped_{v}": F.count_if(~kept & hit) for v, hit in is_.items()}}


def counted_write(rows: DataFrame, kept: Column, counters: dict[str, Column], write: Callable[[DataFrame], None]) -> dict[str, int]:
    """Write the rows that are ``kept`` and give the counters over all of them, from the same scan."""
    seen = Observation()
    write(rows.observe(seen, *(c.alias(name) for name, c in counters.items())).where(kept))
    return dict(seen.get)


class StreamCounters(StreamingQueryListener):
    """Sums the counters that a stream observes under ``name`` over its micro-batches.

    Add it with ``spark.streams.addListener``; ``totals`` grows as batches end.
    """

    def __init__(self, name: str) -> None:
        self.name, self.totals, self._lock = name, Counter(), threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            with self._lock:
                self.totals.update({k: v for k, v in row.asDict().items() if v})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
