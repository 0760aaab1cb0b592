"""A folder of spooled batches: one file each, a checksum before the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DIGITS = 32


def sealed(payload: Column) -> Column:
    """The text of a spool file: the payload behind its checksum."""
    return F.concat(F.md5(payload), payload)


def listing(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, modified, bytes, payload) of the whole files under ``path``, oldest first; corrupt ones are left out.

    Only files that were written to the end have the checksum of what follows it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\n$", "")
    rows = files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), text.alias("text"))
    found = rows.select("path", "modified", "bytes", F.left("text", F.lit(_DIGITS)).alias("sum"), F.expr(f"substring(text, {_DIGITS + 1})").alias("payload"))
    return found.where(F.col("sum") == F.md5("payload")).drop("sum").orderBy("modified", "path")
