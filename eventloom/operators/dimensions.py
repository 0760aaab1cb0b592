"""Lookups against small dimension tables: schemas, callsites, subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.operators.scan import numbered
from eventloom.plans.storage import cut

#: A dimension of more rows than this isn't broadcast.
MAX_BROADCAST_ROWS = 100_000


def small(dim: DataFrame, most: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``dim``, computed once; with a broadcast hint if it has at most ``most`` rows."""
    dim = cut(dim)
    return F.broadcast(dim) if dim.count() <= most else dim


def schema_lookup(envelopes: DataFrame, schemas: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the schema with the envelope's hash, or else with its name."""
    by = lambda key, tag: small(schemas.groupBy(F.col(key).alias(f"{tag}_key")).agg(*((F.min_by if tag == "h" else F.max_by)(c, "ord").alias(f"{tag}_{c}") for c in columns)))
    h, n = by("schema_hash", "h"), by("full_name", "n")
    joined = envelopes.join(h, envelopes.schema_hash == h.h_key, "left").join(n, envelopes.full_name == n.n_key, "left")
    return joined.select(*envelopes.columns, *(F.coalesce(f"h_{c}", f"n_{c}").alias(c) for c in columns))


def split_by_lookup(rows: DataFrame, dim: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the dimension's columns, rows that it doesn't know)."""
    d = small(dim)
    keys = d.select(on)
    return rows.join(d, on), rows.join(keys, on, "left_anti")


def subscribed(envelopes: DataFrame, subscribers: list[dict]) -> DataFrame:
    """One row per envelope and subscriber whose labels and least severity match.

    A subscriber is a dict of name, sev_rank and labels; they are looked up in an index
    (``subscriptions``).
    """
    from eventloom.operators.subscriptions import matched

    table = envelopes.sparkSession.createDataFrame([(s["name"], s["sev_rank"], s["labels"]) for s in subscribers], "name string, sev_rank int, labels map<string,string>")
    return matched(envelopes, table)


def kept_subscribers(subscribers: DataFrame, key: str, now_ns: int, idle_ns: int, most: int, most_per_key: int) -> DataFrame:
    """``subscribers`` (id, since_ns, last_ns, ..) with ``state``: idle, over a cap (the later ones), or live.

    Idle ones go first, then the caps count the rest; both counts are prefix scans.
    """
    live = F.col("last_ns") >= now_ns - idle_ns
    order = ["since_ns", "id"]
    own = numbered(subscribers.withColumn("_live", live), [key, "_live"], order, "_own")
    marked = numbered(own.withColumn("_fits", F.col("_live") & (F.col("_own") <= most_per_key)), ["_fits"], order, "_nth")
    state = F.when(~F.col("_live"), "idle").when(~F.col("_fits"), "over key cap").when(F.col("_nth") > most, "over cap").otherwise("live")
    return marked.withColumn("state", state).select(*subscribers.columns, "state")


def registrations(events: DataFrame, callsite: str, ts: str, tie: str, every: int = 10_000, after_ns: int = 600 * 10**9, parts: int | None = None, least: int | None = None) -> DataFrame:
    """The events at which a callsite is announced: its first, each ``every``-th after it, and all from ``after_ns`` on.

    Only events of the first ``after_ns`` are counted in order, by a prefix scan that spreads
    a hot callsite over tasks; later ones need no order.
    """
    first = events.groupBy(F.col(callsite).alias("_of")).agg(F.min(F.struct(ts, tie)).alias("_first"))
    first = small(first)
    joined = events.join(first, events[callsite] == first["_of"])
    late = F.col(ts) - F.col("_first")[ts] >= after_ns
    early = numbered(joined.where(~late), [callsite], [ts, tie], "_nth", parts, least).where(F.pmod(F.col("_nth") - 1, F.lit(every)) == 0).drop("_nth")
    return early.unionByName(joined.where(late)).drop("_of", "_first")
