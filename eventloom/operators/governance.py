"""Schema governance over a table of declared fields: lints and breaking-change diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.text import is_snake_case
from eventloom.operators.dimensions import small

#: Names of envelope slots that a field may not take.
RESERVED = ("ts_ns", "service", "instance", "schema_hash", "callsite_id", "sev", "tier", "labels", "payload", "sampling_reason")
_SLOTS = {"TRACE_ID": "trace_id", "SPAN_ID": "span_id", "PARENT_SPAN_ID": "parent_span_id"}
_ORDER = ("LOW", "MEDIUM", "HIGH", "UNBOUNDED")

FIELDS = "event string, tag int, field string, kind string, cardinality string, class string, metric string, type string, tier string"


#: Distinct values that a label's cardinality allows.
CAPS = {"LOW": 32, "MEDIUM": 1024}


def lint(fields: DataFrame, prefix: str = "Obs", caps: dict[str, int] | None = None) -> DataFrame:
    """(event, field, rule) of each broken rule; events without fields have one row with a null field.

    ``fields`` has the columns FIELDS, the event as its full name, and where known the number
    of an enumeration's ``variants``, which its cardinality caps (L005).
    """
    if "variants" not in fields.columns:
        fields = fields.withColumn("variants", F.lit(None).cast("int"))
    cap = reduce(lambda a, kv: F.when(F.col("cardinality") == kv[0], kv[1]).otherwise(a), (CAPS if caps is None else caps).items(), F.lit(None).cast("int"))
    c, leaf = F.col, F.regexp_extract("event", r"([^.]*)$", 1)
    slot = reduce(lambda a, kv: F.when(F.col("kind") == kv[0], kv[1]).otherwise(a), _SLOTS.items(), F.lit(None).cast("string"))
    rules: dict[str, Column] = {
        "L001": (c("kind") == "LABEL") & ~c("cardinality").isin("LOW", "MEDIUM"),
        "L002": (c("kind") == "LABEL") & (c("class") == "PII"),
        "L003": (c("class") == "SECRET") & c("tier").isin("LOG", "AUDIT"),
        "L004": (c("kind") == "MEASUREMENT") & c("metric").isNull(),
        "L005": (c("kind") == "LABEL") & (c("variants") > cap),
        "L006": (c("tier") == "AUDIT") & c("class").isin("PII", "SECRET"),
        "L007": ~is_snake_case(c("field")) & c("field").isNotNull(),
        "L012": c("field").isin(*RESERVED) & slot.isNull(),
        "L014": slot.isNotNull() & ((c("field") != slot) | (c("type") != "string")),
    }
    broken = F.array_compact(F.array(*(F.when(hit, F.lit(rule)) for rule, hit in rules.items())))
    by_field = fields.where("field is not null").select("event", "field", F.explode(broken).alias("rule"))
    named = fields.select("event", leaf.alias("leaf")).distinct()
    whole = named.where(~F.col("leaf").startswith(prefix)).select("event", F.lit(None).cast("string").alias("field"), F.lit("L011").alias("rule"))
    empty = fields.groupBy("event").agg(F.count("field").alias("n")).where("n = 0").select("event", F.lit(None).cast("string").alias("field"), F.lit("L009").alias("rule"))
    return by_field.unionByName(whole).unionByName(empty)


def label_conflicts(fields: DataFrame) -> DataFrame:
    """(field, n_signatures): labels that events declare with different types or caps."""
    signature = F.struct("cardinality", "class", "type")
    return fields.where("kind = 'LABEL'").groupBy("field").agg(F.countDistinct(signature).alias("n_signatures")).where("n_signatures > 1")


def hash_collisions(schemas: DataFrame) -> DataFrame:
    """(schema_hash, first_event, second_event): different events with one hash."""
    a, b = schemas.select("schema_hash", F.col("full_name").alias("first_event")), schemas.select(F.col("schema_hash").alias("h"), F.col("full_name").alias("second_event"))
    return a.join(b, (a.schema_hash == b.h) & (a.first_event < b.second_event)).drop("h")


def _rank(c: Column) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in _ORDER)), c)


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """(event, tag, change, verdict) between two field tables; verdict NEW, BREAKING or OK.

    Of one field only the first change counts: kind, then cardinality, then class.
    Looser cardinalities and weaker classes break; so do removed events and fields.
    """
    side = lambda df, p: df.select(*(F.col(x).alias(f"{p}_{x}") for x in ("event", "tag", "kind", "cardinality", "class")))
    b, h = side(base, "b"), side(head, "h")
    names_b, names_h = base.select("event").distinct(), head.select("event").distinct()
    none = F.lit(None).cast("int")
    new = names_h.join(names_b, "event", "left_anti").select("event", none.alias("tag"), F.lit("event added").alias("change"), F.lit("NEW").alias("verdict"))
    gone = names_b.join(names_h, "event", "left_anti").select("event", none.alias("tag"), F.lit("event removed").alias("change"), F.lit("BREAKING").alias("verdict"))
    both = names_b.join(names_h, "event")
    b, h = (x.join(both, F.col(f"{p}_event") == both.event, "left_semi").where(f"{p}_tag is not null") for x, p in ((b, "b"), (h, "h")))
    joined = b.join(h, (b.b_event == h.h_event) & (b.b_tag == h.h_tag), "full_outer")
    shielded = F.col("b_class").isin("PII", "SECRET")
    weaker = shielded & (~F.col("h_class").isin("PII", "SECRET") | ((F.col("b_class") == "SECRET") & (F.col("h_class") == "PII")))
    what = (
        F.when(F.col("h_event").isNull(), F.struct(F.lit("field removed").alias("change"), F.lit("BREAKING").alias("verdict")))
        .when(F.col("b_event").isNull(), F.struct(F.lit("field added").alias("change"), F.lit("OK").alias("verdict")))
        .when(F.col("b_kind") != F.col("h_kind"), F.struct(F.lit("kind").alias("change"), F.lit("BREAKING").alias("verdict")))
        .when(F.col("b_cardinality") != F.col("h_cardinality"), F.struct(F.lit("cardinality").alias("change"), F.when(_rank(F.col("h_cardinality")) > _rank(F.col("b_cardinality")), "BREAKING").otherwise("OK").alias("verdict")))
        .when(F.col("b_class") != F.col("h_class"), F.struct(F.lit("class").alias("change"), F.when(weaker, "BREAKING").otherwise("OK").alias("verdict")))
    )
    changed = joined.select(F.coalesce("b_event", "h_event").alias("event"), F.coalesce("b_tag", "h_tag").alias("tag"), what.alias("w")).where("w is not null")
    return changed.select("event", "tag", "w.change", "w.verdict").unionByName(new).unionByName(gone)


def tallies(changes: DataFrame) -> DataFrame:
    """(verdict, n) of a diff; the change set may not be released if BREAKING is among them."""
    return changes.groupBy("verdict").agg(F.count("*").alias("n"))


def over_budget(notes: DataFrame, own: DataFrame, default: int) -> DataFrame:
    """(site, n, n_waived, budget): sites whose free-form events, but for waived ones, are more than their budget.

    ``own``: (site, budget) of sites with a budget of their own, the least if there are several; the
    others have ``default``.
    """
    site, waived = F.col("labels")["site"], F.coalesce(F.col("labels")["waived"] == "true", F.lit(False))
    used = notes.groupBy(site.alias("site")).agg(F.count("*").alias("n"), F.count_if(waived).alias("n_waived"))
    budgets = small(own.groupBy(F.col("site").alias("_site")).agg(F.min("budget").alias("budget")))
    joined = used.join(budgets, F.col("site") == F.col("_site"), "left").withColumn("budget", F.coalesce("budget", F.lit(default)))
    return joined.where(F.col("n") - F.col("n_waived") > F.col("budget")).select("site", "n", "n_waived", "budget")


def named(findings: DataFrame, parts: list[str], column: str = "event") -> DataFrame:
    """The findings on events whose name has any of ``parts`` in it; all of them without parts."""
    return findings.where(reduce(lambda a, b: a | b, (F.col(column).contains(x) for x in parts))) if parts else findings


def seen_labels(envelopes: DataFrame) -> DataFrame:
    """(event, field, kind): the label keys that each event's rows have, as a field table for ``filter_labels``."""
    pairs = envelopes.select(F.col("full_name").alias("event"), F.explode(F.map_keys("labels")).alias("field")).distinct()
    return pairs.withColumn("kind", F.lit("LABEL"))


def deviating(envelopes: DataFrame, schemas: DataFrame) -> DataFrame:
    """(full_name, known, n, n_other_tier, n_other_sev): how many rows of an event depart from its schema's defaults.

    ``schemas``: (full_name, tier, sev), a row an event; events without a schema are not ``known``.
    """
    rows = envelopes.groupBy("full_name", "tier", "sev").agg(F.count("*").alias("k"))
    own = small(schemas.select("full_name", F.col("tier").alias("_tier"), F.col("sev").alias("_sev")))
    joined = rows.join(own, "full_name", "left")
    off = lambda a, b: F.sum(F.when(F.col(a) != F.col(b), F.col("k")).otherwise(0))
    return joined.groupBy("full_name").agg(F.bool_or(F.col("_tier").isNotNull()).alias("known"), F.sum("k").alias("n"), off("tier", "_tier").alias("n_other_tier"), off("sev", "_sev").alias("n_other_sev"))


def filter_labels(fields: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """(event, label, is_label) for the labels that a filter reads: whether the event declares them as such."""
    asked = fields.sparkSession.createDataFrame(wanted, "event string, label string")
    labels = fields.where("kind = 'LABEL'").select("event", F.col("field").alias("label")).distinct().withColumn("is_label", F.lit(True))
    return asked.join(labels, ["event", "label"], "left").withColumn("is_label", F.coalesce("is_label", F.lit(False)))
