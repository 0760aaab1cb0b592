"""Retention from activity bitmaps: one bit a day and user instead of a join of events with themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days in one word of a bitmap.
WORD = 64


def active_days(events: DataFrame, user: str, day: Column, first: int, last: int) -> DataFrame:
    """(user, words): bit d - ``first`` is set if the user has an event on day d of ``first`` .. ``last``.

    Days are whole numbers.  Words are combined in the map tasks, so what is shuffled is one
    row of (last - first) / 64 longs for each user and task, however many events one has.
    """
    at = day - first
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(WORD)).cast("int"))
    inside = events.withColumns({"_at": at, "_bit": bit}).where((F.col("_at") >= 0) & (F.col("_at") <= last - first))
    words = [F.coalesce(F.bit_or(F.when(F.floor(F.col("_at") / WORD) == w, F.col("_bit"))), F.lit(0).cast("long")) for w in range((last - first) // WORD + 1)]
    return inside.groupBy(user).agg(F.array(*words).alias("words"))


def offsets(words: Column) -> Column:
    """The places of the bits that are set, ascending."""
    every = F.sequence(F.lit(0), F.size(words) * WORD - 1)
    return F.filter(every, lambda i: F.call_function("shiftright", F.get(words, F.floor(i / WORD).cast("int")), F.pmod(i, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)


def retention(events: DataFrame, user: str, day: Column, first: int, last: int) -> DataFrame:
    """(cohort, day_n, users): of the users whose first active day is ``cohort``, how many are active ``day_n`` days later."""
    days = active_days(events.where(F.col(user).isNotNull()), user, day, first, last).select(offsets(F.col("words")).alias("days"))
    since = days.select(F.col("days")[0].alias("start"), F.explode("days").alias("at"))
    return since.groupBy((F.col("start") + first).alias("cohort"), (F.col("at") - F.col("start")).alias("day_n")).agg(F.count("*").alias("users"))
