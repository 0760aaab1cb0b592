"""Vector code compression: product codes by Lloyd's rounds that maintain sums by differences.

Components become whole numbers, floor(scale * x); a vector is cut into equal consecutive
parts and each part is replaced by the index of the nearest entry of its position's codebook.
A round never sums all vectors anew.  The table in the shared folder holds every vector with
the codes of the round before, and running integer sums and counts by entry are kept beside
it.  One narrow pass assigns each part, writes the next table, and adds up in its task the
plus and minus contributions of those parts alone whose code changed: at most one row for
each entry and task is shuffled, whatever a group of equal vectors holds.  Codebooks (parts
x entries x width whole numbers, 128 KiB at 64 components) go to the tasks by closure.  A
round's table is deleted when the next one is written.

Distances are exact: matrix products of doubles where all of them stay below 2**53, Python
integers for the rows where they might not.

Defined results: a row whose vector is null, empty or holds a null, NaN or infinite component
is dropped, and so is one whose length isn't that of most kept rows (the longest of several).
A length that the parts don't divide is filled up with zeros.  Components are held within
+-2**40.  The first entries are the vectors of the smallest ids, each id once (of repeated
rows with different vectors the least vector); null ids come last.  Fewer ids than entries:
the codebook is as short.  Repeated rows are coded alike and each counts in the sums.  Errors
beyond a long are given as the largest long.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.common import MAX_BROADCAST_IDS, cut_lineage, dropped, map_arrow, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LARGEST = (1 << 63) - 1
#: Components are held within plus and minus this.
WIDEST = 1 << 40
#: Rows that are compared with a codebook at once.
BLOCK = 2048


@dataclass
class Codes:
    """Coded vectors (id, label, code binary, error) and the final codebooks [part][entry][position]."""

    rows: DataFrame
    codebooks: list[list[list[int]]]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """(id, label, v): whole components of the rows that are kept, filled up to a multiple of ``parts``."""
    picked = vectors.select(vectors[id_col].alias("id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    schema = T.StructType([picked.schema["id"], picked.schema["label"], T.StructField("v", T.ArrayType(T.LongType()))])

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            values = pc.list_flatten(column)
            x = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).astype(float)
            bad = np.append(0, np.cumsum(~np.isfinite(x)))
            ends = np.cumsum(lengths)
            keep = (lengths > 0) & (bad[ends] == bad[ends - lengths])
            whole = np.clip(np.floor(np.where(np.isfinite(x), x, 0) * scale), -WIDEST, WIDEST).astype(np.int64)[np.repeat(keep, lengths)]
            lengths = lengths[keep].astype(np.int64)
            full = -(-lengths // parts) * parts
            off = np.append(0, np.cumsum(full))
            out = np.zeros(off[-1], np.int64)
            out[np.arange(len(whole)) + np.repeat(off[:-1] - (np.cumsum(lengths) - lengths), lengths)] = whole
            mask = pa.array(keep)
            v = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), v], names=schema.names)

    whole = written(map_arrow(picked, run, schema), "vectors")
    length = whole.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return whole if length is None else whole.where(F.size("v") == length["n"])


def first_entries(whole: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[list[list[int]]]:
    """The parts of the vectors of the ``entries`` smallest ids."""
    ids = whole.select("id").distinct().orderBy(F.asc_nulls_last("id")).limit(entries)
    chosen = whole.join(F.broadcast(ids.withColumnRenamed("id", "chosen")), F.col("id").eqNullSafe(F.col("chosen")))
    rows = chosen.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.asc_nulls_last("id")).collect()
    width = len(rows[0]["v"]) // parts if rows else 0
    return [[r["v"][p * width : (p + 1) * width] for r in rows] for p in range(parts)]


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The index of the entry nearest to each row of ``x`` (int64), the lowest of equals."""
    most = max(int(np.abs(entries).max(initial=0)), 1)
    wide = np.abs(x).max(axis=1, initial=0) >= (1 << 25) / np.sqrt(x.shape[1])
    if most >= (1 << 25) / np.sqrt(x.shape[1]):
        wide[:] = True
    out = np.empty(len(x), np.int64)
    narrow = np.flatnonzero(~wide)
    c = entries.astype(float)
    square = (c * c).sum(axis=1)
    for k in range(0, len(narrow), BLOCK):
        at = narrow[k : k + BLOCK]
        out[at] = np.argmin(square - 2 * (x[at].astype(float) @ c.T), axis=1)
    for i in np.flatnonzero(wide).tolist():
        row = x[i].tolist()
        out[i] = min(range(len(entries)), key=lambda e: sum((a - b) ** 2 for a, b in zip(row, entries[e].tolist(), strict=True)))
    return out


def errors(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``x`` and ``chosen``, as exact integers, at most LARGEST."""
    apart = x - chosen
    if np.abs(apart).max(initial=0) < (1 << 31) / np.sqrt(max(x.shape[1], 1)):
        return (apart * apart).sum(axis=1)
    return np.array([min(sum(a * a for a in row), LARGEST) for row in apart.tolist()], np.int64)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(rows, -1)


def _assigned(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts, _, width = books.shape
    return np.stack([nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)], axis=1)


def _round(state: DataFrame, codebooks: list) -> DataFrame:
    """Vectors with new codes, and rows (part, entry, n, sums) of what the changed parts add and take away."""
    books = np.array(codebooks, np.int64)
    parts, entries, width = books.shape
    kinds = [T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sums", T.ArrayType(T.LongType()))]
    schema = T.StructType([state.schema["id"], state.schema["label"], state.schema["v"], T.StructField("code", T.BinaryType()), *kinds])

    def run(batches):
        sums, n = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        arrow = None
        for batch in batches:
            rows = batch.num_rows
            arrow = batch.schema
            if not rows:
                continue
            x = _matrix(batch.column(2), rows)
            old = None if batch.column(3).null_count else np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(rows, parts)
            new = _assigned(x, books).astype(np.uint16)
            for p in range(parts):
                changed = np.arange(rows) if old is None else np.flatnonzero(old[:, p] != new[:, p])
                part = x[changed, p * width : (p + 1) * width]
                for sign, codes in ((1, new[changed, p]),) if old is None else ((1, new[changed, p]), (-1, old[changed, p])):
                    order = np.argsort(codes, kind="stable")
                    found, at, k = np.unique(codes[order], return_index=True, return_counts=True)
                    if len(found):
                        sums[p, found] += sign * np.add.reduceat(part[order], at, axis=0)
                        n[p, found] += sign * k
            code = pa.array([r.tobytes() for r in new], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], code, *(pa.nulls(rows, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], names=schema.names)
        p, e = np.nonzero((n != 0) | (sums != 0).any(axis=2))
        if arrow is not None and len(p):
            none = [pa.nulls(len(p), arrow.field(i).type) for i in range(3)]
            moved = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([*none, pa.nulls(len(p), pa.binary()), pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), moved], names=schema.names)

    return map_arrow(state.select("id", "label", "v", "code"), run, schema)


def _running(before: DataFrame | None, moved: DataFrame, width: int) -> DataFrame:
    """Sums and counts by entry after the contributions ``moved``, in the shared folder."""
    rows = moved.select("part", "entry", F.col("n").cast("decimal(38,0)").alias("n"), F.col("sums").cast("array<decimal(38,0)>").alias("sums"))
    if before is not None:
        rows = rows.unionByName(before)
    kind = "decimal(38,0)"
    summed = rows.groupBy("part", "entry").agg(F.sum("n").cast(kind).alias("n"), F.array(*(F.sum(F.col("sums")[i]).cast(kind) for i in range(width))).alias("sums"))
    return cut_lineage(summed)


def _final(state: DataFrame, codebooks: list) -> DataFrame:
    books = np.array(codebooks, np.int64)
    parts, _, width = books.shape
    schema = T.StructType([state.schema["id"], state.schema["label"], T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            x = _matrix(batch.column(2), rows)
            new = _assigned(x, books)
            of = np.concatenate([books[p][new[:, p]] for p in range(parts)], axis=1)
            code = pa.array([r.tobytes() for r in new.astype(">u2" if len(books[0]) > 256 else np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(errors(x, of))], names=schema.names)

    return map_arrow(state.select("id", "label", "v"), run, schema)


def compressed(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codes:
    """Product codes of ``vectors``: ``rounds`` rounds of Lloyd's algorithm, then a last assignment.

    ``entries``: at most 65,536.  A code has a byte a part, or two if there are more than 256.
    """
    spark = vectors.sparkSession
    state = quantised(vectors, id_col, vector_col, label_col, parts, scale)
    books = first_entries(state, parts, entries)
    if not books[0]:
        return Codes(state.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(0).cast("long").alias("error")), books)
    width, sums, paths = len(books[0][0]), None, [state]
    state = state.withColumn("code", F.lit(None).cast("binary"))
    for _ in range(rounds):
        both = written(_round(state, books), "codes")
        paths.append(both)
        sums = _running(sums, both.where("part is not null"), width)
        for r in sums.where("n > 0").collect():  # at most parts x entries rows
            books[r["part"]][r["entry"]] = [int(s) // int(r["n"]) for s in r["sums"]]
        state = both.where("part is null").select("id", "label", "v", "code")
        dropped(spark, paths.pop(0))
    rows = written(_final(state, books), "coded")
    dropped(spark, paths.pop())
    return Codes(rows, books)


def label_errors(rows: DataFrame) -> DataFrame:
    """``rows`` and ``label_error``: the errors' sum over equal labels, nulls together."""
    sums = cut_lineage(rows.groupBy(F.col("label").alias("of_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long").alias("label_error")))
    if sums.count() <= MAX_BROADCAST_IDS:
        sums = F.broadcast(sums)
    return rows.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label")


def _oracle() -> str:
    """The same rounds as one chain of DuckDB subqueries."""
    dot = lambda a, b: f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
    best = lambda book: (  # noqa: E731  the nearest entry and its distance in one whole number
        f"SELECT id, p, x, min(CAST({dot('x', 'x')} - 2 * {dot('x', 'c')} + {dot('c', 'c')} AS BIGINT) * {ENTRIES} + e) AS k FROM parts JOIN {book} USING (p) GROUP BY id, p, x"
    )
    out = f"""WITH kept AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS MATERIALIZED (SELECT id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) r(p)),
    book0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY id) - 1 AS e, x AS c FROM parts WHERE id IN (SELECT id FROM kept ORDER BY id LIMIT {ENTRIES}))"""
    for r in range(ROUNDS):
        out += f""", best{r} AS MATERIALIZED ({best(f"book{r}")}),
    sums{r} AS (SELECT p, k % {ENTRIES} AS e, i, CAST(floor(sum(x[i + 1]) / count(*)) AS BIGINT) AS m FROM best{r}, range(len(x)) t(i) GROUP BY ALL),
    book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM book{r} b LEFT JOIN (SELECT p, e, list(m ORDER BY i) AS c FROM sums{r} GROUP BY p, e) n USING (p, e))"""
    return (
        out
        + f""", best{ROUNDS} AS MATERIALIZED ({best(f"book{ROUNDS}")}),
    coded AS (SELECT id, string_agg(printf('%02x', k % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(k // {ENTRIES}) AS BIGINT) AS error FROM best{ROUNDS} GROUP BY id),
    digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
    SELECT id AS vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), digest"""
    )


ORACLE = _oracle()
