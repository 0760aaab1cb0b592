"""The unified events table: layout, Parquet writes, DDL and schema text; idempotent batches."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.text import date_hour, payload_column
from eventloom.operators.scan import summed_before


def with_partitions(envelopes: DataFrame) -> DataFrame:
    at = date_hour(F.col("ts_ns"))
    return envelopes.withColumns({"date": at["date"], "hour": at["hour"]})


def write(envelopes: DataFrame, path: str, by: tuple[str, ...] = ("service", "date"), codec: str = "zstd", mode: str = "append", max_rows: int = 2_000_000, lookup: tuple[str, ...] = ("trace_id",), max_distinct: int = 100_000) -> None:
    """The envelopes as Parquet under ``service=../date=..``; a row's partition decides its file.

    Rows are rebalanced by the partition columns: Spark cuts a hot service and day into parts
    of its advisory partition size and packs small ones into one task, a file each.  Columns of
    ``lookup`` that the rows have get a Bloom filter a row group, so a search for one trace
    skips the groups without it, where least and greatest values exclude nothing.
    """
    placed = with_partitions(envelopes)
    rows = placed.hint("rebalance", *(F.col(c) for c in by)).sortWithinPartitions(*by, "ts_ns")
    out = rows.write.mode(mode).partitionBy(*by).option("compression", codec).option("maxRecordsPerFile", max_rows)
    for c in lookup:
        if c in placed.columns:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", str(max_distinct))
    out.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def typed_payload(envelopes: DataFrame, event: str, fields: dict[str, str]) -> DataFrame:
    """``envelopes`` with a struct column for one event's payload, null for other events.

    ``fields``: column and its class; classified texts become a marker, others null.
    """
    parts = []
    for c, kind in fields.items():
        value = F.col(c)
        if kind in ("PII", "SECRET"):
            is_text = isinstance(envelopes.schema[c].dataType, T.StringType)
            value = F.when(value.isNotNull(), "<redacted>") if is_text else F.lit(None).cast(envelopes.schema[c].dataType)
        parts.append(value.alias(c))
    name = "payload_" + event.lower().replace(".", "_")
    return envelopes.withColumn(name, F.when(F.col("full_name") == event, F.struct(*parts)))


def ddl(schema: T.StructType, table: str, by: tuple[str, ...] = ("service", "date"), location: str | None = None) -> str:
    """CREATE TABLE text; partition columns last, as Spark wants them. ``location``: the folder of an external table."""
    columns = sorted(schema.fields, key=lambda f: f.name in by)
    lines = ",\n".join(f"  `{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in columns)
    return f"CREATE TABLE IF NOT EXISTS {table} (\n{lines}\n) USING parquet PARTITIONED BY ({', '.join(by)})" + (f"\nLOCATION '{location}'" if location else "")


def schema_json(schema: T.StructType) -> str:
    """The schema as JSON with sorted keys: the same text for the same schema."""
    return json.dumps(json.loads(schema.json()), sort_keys=True, indent=1)


def read_as(spark: SparkSession, path: str, schema_text: str) -> DataFrame:
    """A stored table read by the schema that ``schema_json`` gave, without a look into its files."""
    return spark.read.schema(T.StructType.fromJson(json.loads(schema_text))).parquet(path)


def put_batch(path: str):
    """A ``foreachBatch`` function that writes each micro-batch once, however often it is retried."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put


def put_jdbc(url: str, table: str, properties: dict[str, str] | None = None, attempts: int = 5, batch_rows: int = 8192, refused=None):
    """A ``foreachBatch`` function that appends each micro-batch over JDBC, ``batch_rows`` a statement.

    After ``attempts`` failures the batch is given to ``refused`` (a function of the batch, its
    number and the error), or else the query fails and the batch is tried again later.  Rows
    carry the batch's number, so that a replayed batch can be told.
    """
    options = {"batchsize": str(batch_rows), **(properties or {})}

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("batch_number", F.lit(number))
        for attempt in range(attempts):
            try:
                rows.write.mode("append").options(**options).format("jdbc").option("url", url).option("dbtable", table).save()
                return
            except Exception as error:  # noqa: BLE001  whatever the driver raises
                if attempt == attempts - 1:
                    if refused is None:
                        raise
                    refused(batch, number, error)

    return put


def fan_out(puts: list):
    """A ``foreachBatch`` function for several sinks; the batch is computed once."""
    if not puts:
        raise ValueError("no sink")

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for p in puts:
                p(batch, number)
        finally:
            batch.unpersist()

    return put


def evicted(files: DataFrame, most_bytes: int, by: str = "modified", size: str = "bytes", name: str = "path") -> DataFrame:
    """The files to delete so that the newest of a listing stay under ``most_bytes`` together."""
    older = summed_before(files, [], [by, name], F.col(size), "_older")
    every = files.agg(F.sum(size).alias("_every"))  # one row
    return older.join(F.broadcast(every), F.col("_every") - F.col("_older") > most_bytes).select(files.columns)


def newest(files: DataFrame, most: int, by: str = "modified", name: str = "path") -> DataFrame:
    """The ``most`` newest of a listing of files; the rest may be deleted."""
    return files.orderBy(F.desc(by), F.desc(name)).limit(most)


__all__ = ["ddl", "evicted", "fan_out", "newest", "payload_column", "put_batch", "put_jdbc", "read", "read_as", "schema_json", "typed_payload", "with_partitions", "write"]
