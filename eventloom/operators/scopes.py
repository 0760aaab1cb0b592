"""Scopes: inherited fields, correlation, error tails, first rows and thinned repeats of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def innermost(frames: DataFrame, scope: str, depth: str, columns: list[str]) -> DataFrame:
    """(scope, columns): for each column the value of the deepest frame that sets it."""
    return frames.groupBy(scope).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(depth))).alias(c) for c in columns))


def outermost(frames: DataFrame, scope: str, depth: str, column: str) -> DataFrame:
    return frames.groupBy(scope).agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col(depth))).alias(column))


def fill(envelopes: DataFrame, scopes: DataFrame, on: str, labels: list[str]) -> DataFrame:
    """Labels that an envelope lacks, from its scope; what it sets itself wins."""
    given = F.map_filter(F.map_from_arrays(F.array(*(F.lit(x) for x in labels)), F.array(*(F.col(f"scope_{x}") for x in labels))), lambda k, v: v.isNotNull() & ~F.map_contains_key("labels", k))
    named = scopes.select(F.col(on).alias("scope_key"), *(F.col(x).cast("string").alias(f"scope_{x}") for x in labels))
    joined = envelopes.join(named, envelopes[on] == named.scope_key, "left")
    return joined.withColumn("labels", F.map_concat("labels", given)).select(envelopes.columns)


def ancestry(frames: DataFrame, scope: str, depth: str, name: str, sep: str = ":") -> DataFrame:
    """(scope, span_path): a scope's frame names from the outermost in."""
    path = F.transform(F.array_sort(F.collect_list(F.struct(depth, name))), lambda x: x[name])
    return frames.groupBy(scope).agg(F.array_join(path, sep).alias("span_path"))


def error_tail(envelopes: DataFrame, scope: str = "trace_id", most: int = 64) -> DataFrame:
    """The last ``most`` TRACE and DEBUG events of scopes that saw an error, as TAIL_ERROR."""
    bad = envelopes.where("sev_rank >= 5").select(F.col(scope).alias("bad")).distinct()
    quiet = envelopes.where("sev_rank <= 2")
    held = quiet.join(bad, quiet[scope] == bad.bad, "left_semi")
    last = Window.partitionBy(scope).orderBy(F.desc("ts_ns"), F.desc("event_id"))
    return held.withColumn("ring", F.row_number().over(last)).where(F.col("ring") <= most).drop("ring").withColumn("sampling_reason", F.lit("TAIL_ERROR"))


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: what is reported once per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def thinned(counts: Column) -> Column:
    """True at 1, 2, 4, 8...: which repeats of a notice are passed on."""
    return (counts > 0) & (counts.bitwiseAND(counts - 1) == 0)
