"""Line dedup by distinct-site spread, with DataFrame functions only.

For each line hash, HyperLogLog sketches of the sites it occurs on and of the texts it
occurs in merge by aggregation; partial sketches are made before the shuffle, so a line
that a third of all rows carry costs one sketch a task.  Lines whose estimates are near a
threshold get exact distinct counts; the others are decided by their estimates, which are
then at least six standard errors away.

A line is boilerplate if it occurs on ``MIN_SITES`` sites or more and in ``MIN_TEXTS``
different texts or more.  Copies of one text count once, so a document that is copied
across sites keeps its lines, but copies hide no footer that other texts have as well.
Every occurrence of a boilerplate line is removed, alone or in a block of such lines.

Lines are split at \\n and compared without the blanks around them (space, \\x09 to
\\x0D); lines of fewer than ``MIN_CHARS`` characters are never removed.

The documents are read once for the sketches; (line, text, site) is written to the shared
folder as three hashes a line, so the later steps read those and not the texts.

Defined results: a null text counts as empty and stays null; null sites count as no
site; an empty table gives an empty result; repeated rows are treated alike; a text all
of whose lines are boilerplate becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import cut_lineage, free_name, written

MIN_SITES = 5
MIN_TEXTS = 5
MIN_CHARS = 12
#: log2 of a sketch's registers, and how near to a threshold an estimate counts as near.
SKETCH_BITS = 12
MARGIN = 0.1

_BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def occurrences(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, own, line, site) of every line that may be boilerplate, as hashes.

    ``doc`` is a hash of id and text, so repeated ids with other texts stay apart; ``own``
    is the text's.  A line that occurs twice in a text has one row.
    """
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[site_col].cast("string").alias("site"))
    lines = F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_BLANKS)))
    hashed = F.array_distinct(F.transform(F.filter(lines, lambda x: F.length(x) >= min_chars), lambda x: F.xxhash64(x)))
    site = F.when(F.col("site").isNotNull(), F.xxhash64("site"))
    return plain.select(F.xxhash64("id", "text").alias("doc"), F.xxhash64("text").alias("own"), site.alias("site"), F.explode(hashed).alias("line"))


def boilerplate(rows: DataFrame, min_sites: int = MIN_SITES, min_texts: int = MIN_TEXTS) -> DataFrame:
    """(boilerplate): hashes of the boilerplate lines of ``rows`` (line, site, own)."""
    sketched = rows.groupBy("line").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", SKETCH_BITS).alias("s"), F.hll_sketch_agg("own", SKETCH_BITS).alias("t"))
    sites, texts = F.hll_sketch_estimate("s") / min_sites, F.hll_sketch_estimate("t") / min_texts
    close = sketched.where(F.col("n") >= max(min_sites, min_texts)).select("line", F.least(sites, texts).alias("reach")).where(F.col("reach") >= 1 - MARGIN)
    spread = cut_lineage(close.select("line", (F.col("reach") >= 1 + MARGIN).alias("sure")))
    near = spread.where(~F.col("sure")).select(F.col("line").alias("near"))
    exact = rows.join(near, rows.line == near.near).groupBy("line").agg(F.countDistinct("site").alias("s"), F.countDistinct("own").alias("t"))
    found = exact.where((F.col("s") >= min_sites) & (F.col("t") >= min_texts)).select("line")
    return spread.where("sure").select("line").unionByName(found).withColumnRenamed("line", "boilerplate")


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", n_lines: str | None = None, n_removed: str | None = None) -> DataFrame:
    """``docs`` with boilerplate lines gone from the text; other columns stay as they are.

    ``n_lines``, ``n_removed``: names for columns with the counts of lines, if wanted.
    """
    rows = written(occurrences(docs, id_col, text_col, site_col), "lines")
    lines = boilerplate(rows)
    hits = rows.join(lines, rows.line == lines.boilerplate).groupBy("doc").agg(F.collect_set("line").alias("gone"))
    key, doc, gone = (free_name(docs.columns, x) for x in ("key_", "doc_", "gone_"))
    keyed = docs.withColumn(key, F.xxhash64(docs[id_col], docs[text_col].cast("string")))
    joined = keyed.join(hits.select(F.col("doc").alias(doc), F.col("gone").alias(gone)), F.col(key) == F.col(doc), "left")
    taken = F.coalesce(F.col(gone), F.array().cast("array<bigint>"))
    left = F.filter(_lines(F.col(text_col)), lambda x: ~F.array_contains(taken, F.xxhash64(F.btrim(x, F.lit(_BLANKS)))))
    text = F.when(F.size(taken) > 0, F.array_join(left, "\n")).otherwise(F.col(text_col))
    removed = F.when(F.size(taken) > 0, F.size(_lines(F.col(text_col))) - F.size(left)).otherwise(0)
    counts = [x.cast("long").alias(n) for n, x in ((n_lines, F.size(_lines(F.col(text_col)))), (n_removed, removed)) if n]
    return joined.select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns), *counts)


#: DuckDB SQL for the query over ``documents``.
ORACLE = f"""
WITH split_docs AS (
  SELECT doc_id, source, coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), placed AS (
  SELECT doc_id, source, body, ls, unnest(range(1, len(ls) + 1)) AS i FROM split_docs
), line_rows AS (
  SELECT doc_id, source, body, i, ls[i] AS raw, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
  FROM placed
), boilerplate AS (
  SELECT line FROM line_rows WHERE length(line) >= {MIN_CHARS} GROUP BY line
  HAVING count(DISTINCT source) >= {MIN_SITES} AND count(DISTINCT body) >= {MIN_TEXTS}
), marked AS (
  SELECT r.doc_id, r.i, r.raw, b.line IS NOT NULL AS gone FROM line_rows r LEFT JOIN boilerplate b ON r.line = b.line
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
       coalesce(string_agg(CASE WHEN gone THEN NULL ELSE raw END, chr(10) ORDER BY i), '') AS text
FROM marked GROUP BY doc_id
"""
