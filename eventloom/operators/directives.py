"""Filters of thousands of directives: an index of name prefixes instead of a condition each.

A filter's static directives become a table of targets.  The distinct event names are cut into
their whole-segment prefixes, looked up by hash, and the longest target that was found decides
a name; events then look up their name.  Directives with label conditions are gathered by the
event they name, and a row is checked against those of its own name alone.  Plans have the same
size for one directive and for thousands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions.filters import Filter, parse
from eventloom.operators.dimensions import small

#: Names that a filter is evaluated for beforehand at most; more are looked up.
MOST_NAMES = 1000

_STATIC = "target string, level int"
_DYNAMIC = "target string, ord int, labels map<string,string>, level int"


def prefixes(name: Column) -> Column:
    """A name and its parts before each ``.`` and ``::``."""
    at = F.filter(F.sequence(F.lit(1), F.length(name)), lambda i: (F.substr(name, i, F.lit(1)) == ".") | (F.substr(name, i, F.lit(2)) == "::"))
    return F.array_distinct(F.concat(F.transform(at, lambda i: F.substr(name, F.lit(1), i - 1)), F.array(name)))


def _static(spark: SparkSession, rules: Filter) -> DataFrame:
    first: dict[str, int] = {}
    for d in rules.static:
        first.setdefault(d.target, d.level)
    return spark.createDataFrame(list(first.items()), _STATIC)


def decided(names: DataFrame, rules: Filter | str, name: str = "full_name") -> DataFrame:
    """(name, level, dynamic): what the filter says of each distinct name, 0 for off, and its label directives in order."""
    rules = parse(rules) if isinstance(rules, str) else rules
    spark = names.sparkSession
    distinct = names.select(name).distinct()
    cut_up = distinct.select(name, F.explode(prefixes(F.col(name))).alias("target"))
    # the empty target isn't a prefix: a static directive always has a target
    found = cut_up.join(small(_static(spark, rules)), "target").groupBy(name).agg(F.max_by("level", F.length("target")).alias("level"))
    dynamic = spark.createDataFrame([(d.target, i, dict(d.labels), d.level) for i, d in enumerate(rules.dynamic)], _DYNAMIC)
    by_name = dynamic.groupBy(F.col("target").alias(name)).agg(F.array_sort(F.collect_list(F.struct("ord", F.map_entries("labels").alias("labels"), "level"))).alias("dynamic"))
    return distinct.join(found, name, "left").join(small(by_name), name, "left").select(name, F.coalesce("level", F.lit(rules.floor)).alias("level"), "dynamic")


def admitted(envelopes: DataFrame, rules: Filter | str, name: str = "full_name", sev_rank: str = "sev_rank", labels: str = "labels") -> DataFrame:
    """The rows that the filter lets pass: the same as ``where(filters.allowed(rules))``."""
    table = small(decided(envelopes, rules, name).select(F.col(name).alias("_name"), F.col("level").alias("_level"), F.col("dynamic").alias("_dynamic")))
    joined = envelopes.join(table, F.col(name).eqNullSafe(F.col("_name")))
    holds = lambda d: F.forall(d["labels"], lambda e: F.coalesce(F.element_at(labels, e["key"]) == e["value"], F.lit(False)))
    own = F.get(F.filter("_dynamic", holds), F.lit(0))["level"]
    level = F.coalesce(own, F.col("_level"))
    return joined.where((level > 0) & (F.col(sev_rank) >= level)).select(envelopes.columns)


def passing_names(known: list[str], rules: Filter | str, spark: SparkSession, name: str = "full_name") -> list[str]:
    """Those of ``known`` names of which any event may pass: neither off nor without a label directive that isn't."""
    rows = decided(spark.createDataFrame([(k,) for k in known], f"`{name}` string"), rules, name).collect()
    return sorted(r[name] for r in rows if r["level"] > 0 or any(d["level"] > 0 for d in r["dynamic"] or []))


def pruned(envelopes: DataFrame, rules: Filter | str, known: list[str], name: str = "full_name") -> DataFrame:
    """``admitted`` rows of a stored table whose names are ``known``: names that the filter drops never leave the scan.

    The filter is evaluated for the names beforehand and becomes ``name IN (..)``, which
    reaches the files' statistics.  Beyond ``MOST_NAMES`` names the index alone decides.
    """
    if len(known) <= MOST_NAMES:
        envelopes = envelopes.where(F.col(name).isin(passing_names(known, rules, envelopes.sparkSession, name)))
    return admitted(envelopes, rules, name)
