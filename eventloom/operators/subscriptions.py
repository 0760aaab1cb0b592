"""Who gets an event: an index of subscriptions, and caps on what each one gets.

A subscription names label values that an event must all have, and a least severity.  Each is
filed under the one of its conditions that the fewest events meet (one without labels: under
the severities that it takes), so an event looks up its own labels and severity by hash and
only the subscriptions found there are checked in full.  No plan grows with their number.

Subscriptions that ask for the same are looked up once, as one set of conditions.  What is
only counted or capped (``tallied``, ``first_events``) never lists all pairs of subscriptions
and events: events of equal labels and severity meet the same sets, so they are put together
before the lookup, and subscriptions get what their set got after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.envelope import SEVERITIES
from eventloom.operators.dimensions import small
from eventloom.plans.storage import cut

#: The key under which severities are looked up; no label has it.
_SEVERITY = "\0severity"
#: Parts that a subscriber's events are ranked in before they are ranked together.
DEALS = 64


def _conditions(labels: Column) -> Column:
    return F.transform(F.map_entries(labels), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))


def _sorted_conditions(labels: Column) -> Column:
    """Equal for equal maps; a null map is an empty one."""
    return F.array_sort(F.coalesce(_conditions(labels), F.array().cast("array<struct<k:string,v:string>>")))


def filed(subscribers: DataFrame, envelopes: DataFrame) -> DataFrame:
    """(k, v, name, sev_rank, labels): each of ``subscribers`` (name, sev_rank, labels) under its rarest condition."""
    known = cut(subscribers.select("name", "sev_rank", F.coalesce("labels", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("labels")))
    asked = known.select("name", F.explode(_conditions(F.col("labels"))).alias("c")).select("name", "c.k", "c.v")
    wanted = small(asked.select("k", "v").distinct())
    seen = envelopes.select(F.explode(_conditions(F.col("labels"))).alias("c")).select("c.k", "c.v").join(wanted, ["k", "v"], "left_semi").groupBy("k", "v").agg(F.count("*").alias("n"))
    rarest = asked.join(seen, ["k", "v"], "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "k", "v")).alias("c"))
    by_label = known.join(rarest, "name").select("c.k", "c.v", "name", "sev_rank", "labels")
    ranks = F.sequence(F.greatest(F.col("sev_rank"), F.lit(1)), F.lit(len(SEVERITIES)))
    bare = known.where((F.size("labels") == 0) & (F.col("sev_rank") <= len(SEVERITIES)))
    by_rank = bare.select(F.lit(_SEVERITY).alias("k"), F.explode(ranks.cast("array<string>")).alias("v"), "name", "sev_rank", "labels")
    return by_label.unionByName(by_rank)


def matched(envelopes: DataFrame, subscribers: DataFrame) -> DataFrame:
    """``envelopes`` with ``subscriber``: a row for each subscription whose labels and least severity an event meets.

    ``subscribers``: name (unique), sev_rank, labels (a map; null or empty: any).
    """
    index = small(filed(subscribers, envelopes).select(F.col("k").alias("_k"), F.col("v").alias("_v"), F.col("name").alias("subscriber"), F.col("sev_rank").alias("_least"), F.col("labels").alias("_asked")))
    own = F.struct(F.lit(_SEVERITY).alias("k"), F.col("sev_rank").cast("string").alias("v"))
    looked = envelopes.withColumn("_c", F.explode(F.concat(F.coalesce(_conditions(F.col("labels")), F.array().cast("array<struct<k:string,v:string>>")), F.array(own))))
    found = looked.join(index, (F.col("_c.k") == F.col("_k")) & (F.col("_c.v") == F.col("_v")))
    every = F.forall(F.map_entries("_asked"), lambda e: F.coalesce(F.element_at("labels", e["key"]) == e["value"], F.lit(False)))
    return found.where((F.col("sev_rank") >= F.col("_least")) & every).select(*envelopes.columns, "subscriber")


def condition_sets(subscribers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each set of conditions once, as a subscription (name, sev_rank, labels), and the (name, subscriber) that ask for it."""
    known = subscribers.where(F.col("sev_rank").isNotNull()).select(F.col("name").alias("subscriber"), "sev_rank", _sorted_conditions(F.col("labels")).alias("_asked"))
    sets = small(known.select("sev_rank", "_asked").distinct().withColumn("name", F.monotonically_increasing_id()))
    members = known.join(sets, ["sev_rank", "_asked"]).select("name", "subscriber")
    return sets.select("name", "sev_rank", F.map_from_entries("_asked").alias("labels")), members


def tallied(envelopes: DataFrame, subscribers: DataFrame, event: str = "event_id") -> DataFrame:
    """(subscriber, n, first_id, last_id): how many events each gets, and the least and greatest ``event`` of them."""
    sets, members = condition_sets(subscribers)
    alike = envelopes.groupBy("sev_rank", _sorted_conditions(F.col("labels")).alias("labels")).agg(F.count("*").alias("n"), F.min(event).alias("first_id"), F.max(event).alias("last_id"))
    met = matched(cut(alike.withColumn("labels", F.map_from_entries("labels"))), sets)
    totals = (F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    got = small(met.groupBy(F.col("subscriber").alias("name")).agg(*totals))
    return members.join(got, "name").groupBy("subscriber").agg(*totals)


def first_events(envelopes: DataFrame, subscribers: DataFrame, most: int, order: list[str]) -> DataFrame:
    """(subscriber, ``order``): the first ``most`` events that each gets; those are among the first ones of their labels and severity."""
    sets, members = condition_sets(subscribers)
    alike = envelopes.select("sev_rank", _sorted_conditions(F.col("labels")).alias("labels"), *order).withColumn("_alike", F.struct("sev_rank", "labels"))
    first = cut(capped(alike, most, order, "_alike").drop("_alike").withColumn("labels", F.map_from_entries("labels")))
    got = small(capped(matched(first, sets).withColumnRenamed("subscriber", "name"), most, order, "name").select("name", *order))
    return capped(members.join(got, "name"), most, order).select("subscriber", *order)


def capped(hits: DataFrame, most: int, order: list[str], subscriber: str = "subscriber") -> DataFrame:
    """The first ``most`` rows of each subscriber by ``order``.

    Ranked within ``DEALS`` parts of a subscriber first, so one that gets a third of all rows
    leaves at most DEALS times ``most`` of them to a task.
    """
    dealt = hits.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(DEALS)))
    first = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(subscriber, "_part").orderBy(*order))).where(F.col("_nth") <= most)
    return first.withColumn("_nth", F.row_number().over(Window.partitionBy(subscriber).orderBy(*order))).where(F.col("_nth") <= most).drop("_nth", "_part")


def delivery(counts: DataFrame, most: int, subscriber: str = "subscriber") -> DataFrame:
    """(subscriber, delivered, dropped) of ``counts`` (subscriber, n) when each has room for ``most`` rows."""
    n = F.col("n")
    return counts.select(subscriber, F.least(n, F.lit(most).cast("long")).alias("delivered"), F.greatest(n - most, F.lit(0).cast("long")).alias("dropped"))
