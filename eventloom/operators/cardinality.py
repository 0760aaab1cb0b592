"""How many distinct values a label has: stored sketches that merge, exact counts only near a cap.

A table keeps one HyperLogLog sketch for each group and hour.  Longer spans are unions of
sketches and never read the events again; only groups whose estimate lies within the sketch's
error of a cap are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.dimensions import small

#: log2 of a sketch's buckets, and its relative standard error: about 1.04 / sqrt(4096).
LG_K = 12
ERROR = 1.04 / (1 << LG_K) ** 0.5
#: A true count lies within so many standard errors of its estimate (99.99 %).
SIGMAS = 4
HOUR_NS = 3600 * 10**9


def hourly_sketches(events: DataFrame, keys: list[str], value: str, ts: str = "ts_ns") -> DataFrame:
    """(keys, hour_ns, sketch): the distinct values of each group and hour; nulls don't count."""
    hour = (F.col(ts) - F.pmod(F.col(ts), F.lit(HOUR_NS))).alias("hour_ns")
    return events.where(F.col(value).isNotNull()).groupBy(*keys, hour).agg(F.hll_sketch_agg(value, LG_K).alias("sketch"))


def store(events: DataFrame, keys: list[str], value: str, path: str, ts: str = "ts_ns") -> None:
    """Add the sketches of ``events`` to the table at ``path``; hours that are already there get a second one, and merge."""
    hourly_sketches(events, keys, value, ts).write.mode("append").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def estimated(sketches: DataFrame, by: list[str | Column]) -> DataFrame:
    """(by, about, low, high): the distinct values of unions of sketches, with the bounds of ``SIGMAS`` errors."""
    merged = sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    margin = F.col("about") * (SIGMAS * ERROR)
    return merged.withColumns({"low": F.floor(F.col("about") - margin), "high": F.ceil(F.col("about") + margin)})


def over_cap(events: DataFrame, sketches: DataFrame, keys: list[str], value: str, cap: int) -> DataFrame:
    """(keys, over, about, counted): whether a group has more than ``cap`` distinct values.

    ``counted``: the sketch couldn't tell, so the group's events were read and counted.
    """
    guess = estimated(sketches, keys)
    near = small(guess.where((F.col("low") <= cap) & (F.col("high") > cap)).select(*keys))
    exact = events.join(near, keys, "left_semi").groupBy(*keys).agg(F.countDistinct(value).alias("exact"))
    joined = guess.join(exact, keys, "left")
    return joined.select(*keys, (F.coalesce("exact", "about") > cap).alias("over"), "about", F.col("exact").isNotNull().alias("counted"))
