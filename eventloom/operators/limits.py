"""Greedy acceptance, debounce and token bucket, in built-in operators and without a loop over rows.

What a row does depends on the row accepted before it.  ``debounced`` turns that into
pointers (the first row that may follow if this one is accepted, found as-of) and doubles
them, so a chain of n accepted rows takes log n rounds.  ``token_bucket`` uses that a
bucket's level has a closed form between two moments at which it is full: running greatest
and least values (``scan``).  Most moments that are full whatever came before are found at
once; each round settles one further stretch behind every one of them, all at the same time.
Both spread a hot key over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.operators.dimensions import small
from eventloom.operators.scan import Scan
from eventloom.plans.storage import cut

#: Rows back that are looked at for moments at which a bucket is surely full; any number is right.
LOOK_BACK = 12


def debounced(df: DataFrame, key: str, ts: str = "ts_ns", tie: str = "event_id", gap_ms: int = 200, parts: int | None = None, least: int | None = None) -> DataFrame:
    """``df`` with ``admitted``: the row is ``gap_ms`` or more after the last admitted one of its key.

    ``ts`` and ``tie`` tell a key's rows apart and aren't null.
    """
    gap, one = gap_ms * 10**6, F.lit(1).cast("long")
    scan = Scan(df, [key], [ts, tie], parts, least)
    rows = cut(scan.running(scan.rows, {"_at": ("sum", one)}).drop("_chunk", "_hot"))
    # rows and, at the time from which a next one may be accepted, questions: how many rows come before?
    real = rows.select(F.col(key).alias("k"), F.col(ts).alias("t"), F.lit(1).alias("side"), F.col("_at").alias("at"), one.alias("one"))
    asked = real.select("k", (F.col("t") + gap).alias("t"), F.lit(0).alias("side"), "at", F.lit(0).cast("long").alias("one"))
    both = Scan(real.unionByName(asked), ["k"], ["t", "side", "at"], parts, least)
    found = both.running(both.rows, {"to": ("sum", F.col("one"))}).where("side = 0").select("k", "at", "to")
    jump = cut(found.join(rows.select(F.col(key).alias("k2"), F.col("_at").alias("to2")), F.col("k").eqNullSafe(F.col("k2")) & (F.col("to") == F.col("to2")), "left_semi"))
    # a row that comes ``gap`` after the one before it is accepted whatever came before
    known = cut(rows.where("_at = 0").select(F.col(key).alias("k"), F.lit(0).cast("long").alias("at")).unionByName(jump.where("to = at + 1").select("k", F.col("to").alias("at"))))
    while True:
        ahead = known.join(jump.select(F.col("k").alias("k2"), F.col("at").alias("from"), "to"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("at") == F.col("from"))).select("k", F.col("to").alias("at")).distinct()
        mine = known.select(F.col("k").alias("k2"), F.col("at").alias("at2"))
        new = cut(ahead.join(mine, F.col("k").eqNullSafe(F.col("k2")) & (F.col("at") == F.col("at2")), "left_anti"))
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
        over = jump.select(F.col("k").alias("k2"), F.col("at").alias("from"), F.col("to").alias("further"))
        jump = cut(jump.join(over, F.col("k").eqNullSafe(F.col("k2")) & (F.col("to") == F.col("from"))).select("k", "at", F.col("further").alias("to")))
    hits = known.select(F.col("k").alias("k2"), F.col("at").alias("at2"))
    joined = rows.join(hits, F.col(key).eqNullSafe(F.col("k2")) & (F.col("_at") == F.col("at2")), "left")
    return joined.select(*df.columns, F.col("at2").isNotNull().alias("admitted"))


def token_bucket(df: DataFrame, key: str, ts: str = "ts_ns", tie: str = "event_id", rate_per_s: float = 1.0, burst: int = 5, parts: int | None = None, least: int | None = None) -> DataFrame:
    """``df`` with ``admitted``: a key's bucket holds ``burst`` tokens, gains ``rate_per_s`` and gives one to a row if it can.

    In whole nanoseconds: a token is 1e9 / rate of them, rounded.  With p the place of a row and
    g = ts - token * p, a bucket that was full at row s and refused nothing since holds
    full + g - (greatest g since s).  Once it refuses, the rows accepted up to a row i are
    i + least over j of (tokens earned up to j) - j.
    """
    token = round(1e9 / rate_per_s)
    full = burst * token
    scan = Scan(df, [key], [ts, tie], parts, least)
    places = scan.running(scan.rows, {"_p": ("sum", F.lit(1).cast("long"))}).withColumn("_g", F.col(ts) - F.col("_p") * token)
    # full whatever came before: enough time to fill up from nothing since one of the last rows,
    # though each row after it took a token, and no earlier fill among them was better
    near = Window.partitionBy(key, "_chunk").orderBy(ts, tie)
    sure = F.col("_p") == 0
    for k in range(1, LOOK_BACK + 1):
        filled = F.lag("_g", k).over(near) <= F.col("_g") + token - full
        sure |= filled if k == 1 else filled & (F.max("_g").over(near.rowsBetween(1 - k, -1)) <= F.col("_g"))
    marked = cut(places.withColumn("_sure", F.coalesce(sure, F.lit(False)).cast("long")))
    active = cut(scan.running(marked, {"_seg": ("sum", F.col("_sure"))}).withColumn("_seg", F.col("_seg") + F.col("_sure")).drop("_sure"))
    done = []
    while not active.isEmpty():
        own = F.struct(F.col("_g").alias("g"), F.col("_p").alias("p"))
        r = scan.running(active, {"_top": ("max", own)}, ["_seg"]).withColumn("_top", F.greatest("_top", own))
        refused = full + F.col("_g") - F.col("_top.g") < token
        first = r.groupBy(F.col(key).alias("k2"), F.col("_seg").alias("seg2")).agg(F.min(F.when(refused, F.struct("_p", F.col("_top.p").alias("s"), F.col("_top.g").alias("g")))).alias("_f"))
        first = small(first.where("_f is not null").select("k2", "seg2", F.col("_f.s").alias("_s"), (F.col("_f.g") + token * F.col("_f.s")).alias("_s_ts")))
        tagged = cut(active.join(first, F.col(key).eqNullSafe(F.col("k2")) & (F.col("_seg") == F.col("seg2")), "left").drop("k2", "seg2"))
        free = F.col("_s").isNull() | (F.col("_p") < F.col("_s"))
        done.append(tagged.where(free).select(*df.columns, F.lit(True).alias("admitted")))
        earned = F.expr(f"({full} + `{ts}` - _s_ts) div {token}") - F.col("_p")
        busy = tagged.where(~free).withColumn("_e", earned)
        least_ = lambda *c: F.least(1 - F.col("_s"), *c)
        b = scan.running(busy, {"_m": ("min", F.col("_e"))}, ["_seg"])
        b = b.withColumns({"_had": F.col("_p") - 1 + least_("_m"), "_has": F.col("_p") + least_("_m", "_e")})
        again = (F.col("_p") > F.col("_s")) & (F.col(ts) - F.col("_s_ts") >= token * F.col("_had"))
        b = cut(b.withColumn("_again", F.when(again, F.col("_p"))))
        end = small(b.groupBy(F.col(key).alias("k2"), F.col("_seg").alias("seg2")).agg(F.min("_again").alias("_end")).where("_end is not null"))
        ended = cut(b.join(end, F.col(key).eqNullSafe(F.col("k2")) & (F.col("_seg") == F.col("seg2")), "left"))
        over = F.coalesce(F.col("_p") >= F.col("_end"), F.lit(False))
        done.append(ended.where(~over).select(*df.columns, (F.col("_has") > F.col("_had")).alias("admitted")))
        active = ended.where(over).select(*active.columns)
    if not done:
        return df.limit(0).withColumn("admitted", F.lit(True))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
