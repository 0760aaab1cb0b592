"""Helpers that several operators share: shared storage, Arrow batches, columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from eventloom.plans.shipping import ship
from eventloom.plans.storage import shared_folder

def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder; later reads survive lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as Parquet in the shared folder: columnar, so better for wide rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark, df: DataFrame) -> None:
    """Delete the folders that ``df``, made by ``written``, is read from; nothing may read it any more."""
    root = shared_folder(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == root.rsplit("/", 1)[-1]:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(taken: list[str], wish: str) -> str:
    """``wish``, with underscores added until it clashes with no name in ``taken``."""
    have = {x.lower() for x in taken}
    while wish.lower() in have:
        wish += "_"
    return wish


def row_slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts together hold about ``most`` bytes; one row at least."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def map_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, which give memory back after each task."""
    ship(df.sparkSession)

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def give_back() -> None:
    """Return what the task no longer uses to the system: a worker lives on, idle, beside the JVM."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it trims by itself or not at all
        pass


def map_texts(df: DataFrame, text: str, keep: list[str], fields: list, start) -> DataFrame:
    """Columns ``keep`` as they are, and ``fields`` made from the texts, in one narrow pass.

    ``start()`` runs once a task and gives a function from the bytes and offsets of a
    slice of texts (see ``vectext.buffers``) to a list of arrays, one a field.
    """
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    from eventloom.llm import vectext

    schema = T.StructType([*(df.schema[c] for c in keep), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names
    inner = free_name(keep, "text_")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, hi in row_slices(column, 8 * vectext.SLICE):
                parts = [make(*vectext.buffers(column.slice(lo + a, b - a))) for a, b in row_slices(column.slice(lo, hi - lo), vectext.SLICE)]
                made = [pa.concat_arrays([_array(p[i], kind) for p in parts]) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(keep))), *made], names=names)

    return map_arrow(df.select(*(df[c] for c in keep), df[text].cast("string").alias(inner)), run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def bounded_sample(ids: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` rows of ``ids`` (one a ``key``) of the least hashes of ``key``: the same on every run."""
    from pyspark.sql import functions as F

    return ids.orderBy(F.xxhash64(F.col(key), F.lit(11)), key).limit(most)


#: Ids that are dropped by a broadcast: at most so many, about 16 MB.
MAX_BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is in the first column of ``gone``; all columns stay.

    A list of at most ``MAX_BROADCAST_IDS`` ids is broadcast; a longer one is joined with
    a shuffle.  Null ids in ``gone`` take out rows with a null id.
    """
    from pyspark.sql import functions as F

    name = free_name(docs.columns, "gone_id")
    ids = cut_lineage(gone.select(F.col(gone.columns[0]).alias(name)).distinct())
    n = ids.count()
    if not n:
        return docs
    if n <= MAX_BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[id_col].cast(ids.schema[name].dataType).eqNullSafe(ids[name]), "left_anti")


def flagged(docs: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """``docs`` and a column ``flag``: whether ``key`` is in the first column of ``ids``.

    A list of at most ``MAX_BROADCAST_IDS`` ids is broadcast, a longer one is joined with a
    shuffle; the rows are the same.
    """
    from pyspark.sql import functions as F

    name = free_name(docs.columns, "flagged_id")
    some = cut_lineage(ids.select(F.col(ids.columns[0]).alias(name)).where(F.col(name).isNotNull()).distinct())
    some = F.broadcast(some) if some.count() <= MAX_BROADCAST_IDS else some.hint("merge")
    return docs.join(some, docs[key] == some[name], "left").select(*docs.columns, F.col(name).isNotNull().alias(flag))
