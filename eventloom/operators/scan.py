"""Running sums, greatest and least values over each key's rows in order, hot keys spread over tasks.

A window puts a key's rows in one task.  Here a key that holds more than a task's share of
the rows is cut into chunks of its order, at bounds taken from a sample of its own rows (the
sample only decides where to cut).  Each chunk is folded to one value, the few values of a key
are scanned, and what came before a chunk is added to the running value inside it: a
segmented prefix scan of two levels, all in built-in operators.  Other keys are one chunk, and
without a hot key the plan is the plain window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.plans.storage import cut

#: Sampled rows between two bounds, and bounds between two of the search's upper level.
EVERY, BLOCK = 32, 32
#: Keys of fewer rows are never cut: a task sorts them at once.
LEAST = 10_000

_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _same(a: DataFrame, b: DataFrame, columns: dict[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[d]) for c, d in columns.items()])


def _renamed(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    names = {c: f"_of_{c}" for c in columns}
    return df.withColumnsRenamed(names), names


class Scan:
    """The rows of ``df`` with ``_chunk`` (its key's chunk, rising with the order) and ``_hot``.

    ``order``: columns that together tell a key's rows apart, ascending, nulls first; rows that
    are alike in all of them stay in one chunk.  ``parts``: a key is hot beyond 1/parts of all
    rows (the session's shuffle partitions unless given).
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None, least: int | None = None) -> None:
        self.order = order
        if not keys:
            df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
        self.keys = keys
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = df.count()
        share = max(n / parts, LEAST if least is None else least)
        hot = cut(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > share).select(*keys))  # fewer than ``parts`` rows
        self.hot = not hot.isEmpty()
        if not self.hot:
            self.rows = df.withColumns({"_chunk": F.lit(0), "_hot": F.lit(False)})
            return
        named, names = _renamed(hot, keys)
        one_in = max(1, n // (EVERY * parts))
        sample = df.where(F.pmod(F.xxhash64(*order), F.lit(one_in)) == 0).join(F.broadcast(named), _same(df, named, names))
        bounds = sample.groupBy(*names.values()).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s"))
        bounds = bounds.withColumn("_bounds", F.filter("s", lambda x, i: i % EVERY == EVERY - 1))
        bounds = cut(bounds.withColumn("_tops", F.filter("_bounds", lambda x, i: i % BLOCK == BLOCK - 1)).drop("s"))
        at = F.struct(*(F.col(c) for c in order))
        below = lambda values: F.size(F.filter(values, lambda x: x < at))
        block = below(F.col("_tops")) * BLOCK
        chunk = F.when(F.col("_bounds").isNull(), 0).otherwise(block + below(F.slice("_bounds", block + 1, F.lit(BLOCK))))
        joined = df.join(F.broadcast(bounds), _same(df, bounds, names), "left")
        self.rows = joined.withColumns({"_chunk": chunk, "_hot": F.col("_bounds").isNotNull()}).drop("_bounds", "_tops", *names.values())

    def running(self, rows: DataFrame, values: dict[str, tuple[str, Column]], within: list[str] | None = None) -> DataFrame:
        """``rows`` (of this scan) and for each name the fold (sum, max or min) of a value over the rows before.

        A sum is 0 and the others are null where no row comes before.  ``within``: columns
        beside the key that tell groups of rows that follow each other.
        """
        groups = [*self.keys, *(within or [])]
        own = Window.partitionBy(*groups, *(["_chunk"] if self.hot else [])).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, -1)
        local = {name: _FOLDS[kind](v).over(own) for name, (kind, v) in values.items()}
        if not self.hot:
            return rows.withColumns({name: F.coalesce(v, F.lit(0)) if values[name][0] == "sum" else v for name, v in local.items()})
        totals = rows.where("_hot").groupBy(*groups, "_chunk").agg(*(_FOLDS[kind](v).alias(f"_b_{name}") for name, (kind, v) in values.items()))
        before = Window.partitionBy(*groups).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row a chunk
        carried = totals.withColumns({f"_b_{name}": _FOLDS[kind](f"_b_{name}").over(before) for name, (kind, _) in values.items()})
        # only groups that reach over a chunk's border carry something: at most one a chunk
        some = reduce(lambda a, b: a | b, [F.col(f"_b_{name}").isNotNull() for name in values])
        named, names = _renamed(cut(carried.where(some)), [*groups, "_chunk"])
        joined = rows.withColumns(local).join(F.broadcast(named), _same(rows, named, names), "left").drop(*names.values())
        both = {}
        for name, (kind, _) in values.items():
            mine, carry = F.col(name), F.col(f"_b_{name}")
            both[name] = F.coalesce(mine, F.lit(0)) + F.coalesce(carry, F.lit(0)) if kind == "sum" else (F.greatest if kind == "max" else F.least)(mine, carry)
        return joined.withColumns(both).drop(*(f"_b_{name}" for name in values))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = None, least: int | None = None) -> DataFrame:
    """``df`` and ``name``: the place of each row among its key's, from 1."""
    scan = Scan(df, keys, order, parts, least)
    return scan.running(scan.rows, {name: ("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) + 1).select(*df.columns, name)


def summed_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, parts: int | None = None, least: int | None = None) -> DataFrame:
    """``df`` and ``name``: the sum of ``value`` over the rows of its key before each row."""
    scan = Scan(df, keys, order, parts, least)
    return scan.running(scan.rows, {name: ("sum", value)}).select(*df.columns, name)
