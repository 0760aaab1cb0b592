"""Connected components of links between integer ids, with DataFrame joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut_lineage

#: A round takes one task for so many edges, up to the number of shuffle partitions.
EDGES_A_TASK = 250_000


def _pairs(rows: DataFrame, *ends: tuple[str, str]) -> DataFrame:
    """(u, v) for each row and each two columns of ``ends``: no union, so one partition stays one."""
    return rows.select(F.inline(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in ends))))


def _gathered(edges: DataFrame, n: int) -> DataFrame:
    """``edges``, ``n`` of them, in no more partitions than their number asks for."""
    tasks = -(-n // EDGES_A_TASK)
    return edges.coalesce(tasks) if tasks < int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else edges


def _minimum_of_neighbours(edges: DataFrame, emit_greater: bool, n: int) -> DataFrame:
    """One star step over directed edges (u, v), made of ``n``: link u's neighbours to their least one."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("hub"), F.least("u", "least").alias("m"))
    least = F.broadcast(least) if n <= EDGES_A_TASK else least
    joined = _gathered(edges.join(least, edges.u == least.hub), n)
    linked = _pairs(joined.where("v > u"), ("v", "m")) if emit_greater else _pairs(joined, ("v", "m"), ("hub", "m"))
    return _gathered(linked.where("u <> v").distinct(), n)


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (u, v) that isn't the least of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until every id is
    linked to the least id it reaches; the number of rounds grows with the logarithm of
    a component's size.  Each round's edges are checkpointed to shared storage.

    Most graphs have few edges for the rows that they come from, so the tasks of a round
    follow the edges' number: up to ``EDGES_A_TASK`` of them are one task and a broadcast
    without a shuffle; from so many for each shuffle partition on, Spark's own number holds.
    """
    edges = cut_lineage(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        state = now
        both = _pairs(_gathered(edges, now[0]), ("u", "v"), ("v", "u"))
        large = _minimum_of_neighbours(both, True, now[0])
        edges = cut_lineage(_minimum_of_neighbours(large, False, now[0]))
