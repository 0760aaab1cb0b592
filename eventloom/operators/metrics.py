"""Metric series: counters, gauges, histograms, caps on series and label values, text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.text import float_text, label_escape
from eventloom.operators.dimensions import small


#: Parts that the series of one metric are dealt into.
DEALS = 64


def counters(points: DataFrame, series: list[str], value: Column) -> DataFrame:
    return points.groupBy(*series).agg(F.sum(value).alias("total"))


def gauges(points: DataFrame, series: list[str], value: str, order: list[str]) -> DataFrame:
    """The last value of each series in the order of ``order``."""
    return points.groupBy(*series).agg(F.max_by(value, F.struct(*order)).alias("last_value"))


def histograms(points: DataFrame, series: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets as an array, the count (which is +Inf's) and the sum; nulls don't count."""
    at_most = [F.count_if(F.col(value) <= b) for b in bounds]
    return points.groupBy(*series).agg(F.array(*at_most).alias("buckets"), F.count(value).alias("n"), F.sum(value).alias("total"))


def bounds_by_metric(declared: DataFrame) -> DataFrame:
    """(metric, bounds): the ascending bounds of each metric of ``declared`` (metric, bounds), once.

    Order, repeats and nulls within a declaration don't matter; ValueError if a metric is declared with different bounds.
    """
    clean = declared.where("metric is not null").select("metric", F.array_sort(F.array_distinct(F.filter("bounds", lambda b: b.isNotNull()))).alias("b"))
    found = small(clean.groupBy("metric").agg(F.min("b").alias("bounds"), F.max("b").alias("last")))
    clash = [r["metric"] for r in found.where("bounds <> last").select("metric").orderBy("metric").limit(5).collect()]
    if clash:
        raise ValueError(f"metrics with different bounds: {clash}")
    return found.select("metric", "bounds")


def metric_histograms(points: DataFrame, series: list[str], metric: str, value: str, declared: DataFrame) -> DataFrame:
    """(series.., bounds, buckets, n, total): histograms by the bounds declared for each metric.

    ``metric`` is one of ``series``.  A point is put into the first bucket that holds it and counted
    there before the shuffle, so a hot series sends a row for each bucket and task.  Metrics without
    a declaration have no bounds, only n and total; nulls don't count and NaN is over every bound.
    """
    found = bounds_by_metric(declared).select(F.col("metric").alias("_metric"), F.col("bounds").alias("_bounds"))
    known = points.join(found, F.col(metric) == F.col("_metric"), "left")
    place = F.size(F.filter(F.coalesce("_bounds", F.array().cast("array<double>")), lambda b: b < F.col(value)))
    counted = known.where(F.col(value).isNotNull()).groupBy(*series, place.alias("_at")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.first("_bounds").alias("_bounds"))
    hit = F.collect_list(F.struct(F.col("_at"), F.col("n").alias("k")))  # at most one more than bounds
    folded = counted.groupBy(*series).agg(hit.alias("_hit"), F.sum("n").alias("n"), F.sum("total").alias("total"), F.first("_bounds").alias("_bounds"))
    at_most = lambda i: F.aggregate(F.filter("_hit", lambda h: h["_at"] <= i), F.lit(0).cast("long"), lambda a, h: a + h["k"])
    bounds = F.coalesce("_bounds", F.array().cast("array<double>"))
    return folded.select(*series, bounds.alias("bounds"), F.transform(bounds, lambda b, i: at_most(i)).alias("buckets"), "n", "total")


def capped_series(points: DataFrame, name: str, series: str, order: list[str], most: int) -> DataFrame:
    """(name, series, admitted, n): series by first appearance; those beyond ``most`` are refused.

    The first ``most`` of a name are found by ranks within ``DEALS`` hashed parts of it and then
    among what is left of those, so no task sees all series of one name.
    """
    seen = points.groupBy(name, series).agg(F.min(F.struct(*order)).alias("first_at"), F.count("*").alias("n"))
    part = seen.select(name, series, "first_at", F.pmod(F.xxhash64(series), F.lit(DEALS)).alias("_part"))
    best = part.withColumn("_nth", F.row_number().over(Window.partitionBy(name, "_part").orderBy("first_at", series))).where(F.col("_nth") <= most)
    first = best.withColumn("_nth", F.row_number().over(Window.partitionBy(name).orderBy("first_at", series))).where(F.col("_nth") <= most)
    last = first.groupBy(F.col(name).alias("_name")).agg(F.max(F.struct("first_at", series)).alias("_last"))
    joined = seen.join(last, seen[name].eqNullSafe(last["_name"]), "left")
    return joined.select(name, series, (F.struct("first_at", series) <= F.col("_last")).alias("admitted"), "n")


def alive(points: DataFrame, series: list[str], ts: str, now_ns: int, ttl_ns: int) -> DataFrame:
    """Series with their last time, whether they had a point within ``ttl_ns`` before ``now_ns``."""
    return points.groupBy(*series).agg(F.max(ts).alias("last_ns")).withColumn("alive", F.col("last_ns") >= now_ns - ttl_ns)


def admitted_values(points: DataFrame, value: str, order: list[str], most: int, within: list[str] | None = None) -> DataFrame:
    """Rows before the first one whose value would be distinct value number ``most`` + 1.

    Once the cap is broken nothing is admitted any more, old values neither.
    """
    within = within or []
    seen = points.groupBy(*within, value).agg(F.min(F.struct(*order)).alias("first_at"))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy("first_at") if within else Window.orderBy("first_at"))
    cut = seen.withColumn("nth", rank).where(F.col("nth") == most + 1).select(*(F.col(c).alias(f"cut_{c}") for c in within), F.col("first_at").alias("cut"))
    on = [points[c].eqNullSafe(cut[f"cut_{c}"]) for c in within]
    joined = points.join(cut, on, "left") if within else points.join(F.broadcast(cut), F.lit(True), "left")
    return joined.where(F.col("cut").isNull() | (F.struct(*order) < F.col("cut"))).select(points.columns)


def label_block(labels: Column, extra: list[Column] | None = None) -> Column:
    """``{k="v",..}`` by key; empty without labels. ``extra``: structs (key, value)."""
    every = F.array_sort(F.concat(F.map_entries(labels), F.array(*extra)) if extra else F.map_entries(labels))
    inner = F.array_join(F.transform(every, lambda e: F.concat(e["key"], F.lit('="'), label_escape(e["value"]), F.lit('"'))), ",")
    return F.when(F.size(every) == 0, "").otherwise(F.concat(F.lit("{"), inner, F.lit("}")))


def exposition(series: DataFrame, bounds: list[float], kind: str = "histogram") -> DataFrame:
    """Text lines (name, labels_key, pos, line) of histogram or counter ``series``; order by the first three.

    ``series`` has name and labels, with buckets, n and total for histograms, total else.
    """
    key = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    if kind == "histogram":
        le = lambda v: [F.struct(F.lit("le").alias("key"), v.alias("value"))]
        rows = [F.concat("name", F.lit("_bucket"), label_block(F.col("labels"), le(float_text(F.lit(float(b))))), F.lit(" "), F.col("buckets")[i].cast("string")) for i, b in enumerate(bounds)]
        rows.append(F.concat("name", F.lit("_bucket"), label_block(F.col("labels"), le(F.lit("+Inf"))), F.lit(" "), F.col("n").cast("string")))
        rows.append(F.concat("name", F.lit("_sum"), label_block(F.col("labels")), F.lit(" "), float_text(F.col("total"))))
        rows.append(F.concat("name", F.lit("_count"), label_block(F.col("labels")), F.lit(" "), F.col("n").cast("string")))
    else:
        rows = [F.concat("name", label_block(F.col("labels")), F.lit(" "), F.col("total").cast("string"))]
    body = series.select("name", key.alias("labels_key"), F.posexplode(F.array(*rows)).alias("pos", "line"))
    heads = series.select("name").distinct().select("name", F.lit("").alias("labels_key"), F.explode(F.array(F.struct(F.lit(-2).alias("pos"), F.concat(F.lit("# HELP "), F.col("name"), F.lit(" series")).alias("line")), F.struct(F.lit(-1).alias("pos"), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(f" {kind}")).alias("line")))).alias("x"))
    return body.unionByName(heads.select("name", "labels_key", "x.pos", "x.line"))
