"""The queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import collocations, decontam, html_render, langid, line_dedup, lm_score, packing, pii, prefix_hash, product_codes, quality, simhash, toxicity

#: Limits of an instruction sequence: tokens, turns, and tokens that bear loss.
TOKENS, SEGMENTS, LOSS = 2048, 16, 1024

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.score(docs, table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@query
def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extracted(table(spark, sf_dir, "pages"), keep=["page_id"])


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "segment", "padded")


@query
def packed_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each conversation its segments, and whether its sequence keeps all three limits and has no gaps.

    ``alone``: it breaks a limit by itself.
    """
    placed = packing.pack_conversations(table(spark, sf_dir, "conversations"), tokens=TOKENS, segments=SEGMENTS, loss=LOSS)
    sums = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("segments").alias("s"), F.sum("loss").alias("l"), F.count("*").alias("k"))
    in_order = W.partitionBy("sequence_id").orderBy("offset")  # SEGMENTS rows at most
    follows = placed.withColumn("gapless", F.col("offset") == F.coalesce(F.lag(F.col("offset") + F.col("length")).over(in_order), F.lit(0)))
    within = (F.col("n") <= TOKENS) & (F.col("s") <= SEGMENTS) & (F.col("l") <= LOSS)
    own = (F.col("length") > TOKENS) | (F.col("segments") > SEGMENTS) | (F.col("loss") > LOSS)
    return follows.join(sums, "sequence_id").select("conv_id", "segments", (within | own & (F.col("k") == 1)).alias("fits"), "gapless")


ORACLE["packed_conversations"] = "SELECT conv_id, count(*) AS segments, true AS fits, true AS gapless FROM conversations GROUP BY conv_id"


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = line_dedup.cleaned(table(spark, sf_dir, "documents"), n_lines="n_lines", n_removed="n_removed")
    return docs.select("doc_id", "n_lines", "n_removed", F.coalesce("text", F.lit("")).alias("text"))


ORACLE["op9_line_dedup"] = line_dedup.ORACLE


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).withColumnRenamed("accepted", "kept")


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE["op11_phrase_collocations"] = collocations.ORACLE


@query
def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.edited(table(spark, sf_dir, "documents"))


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = product_codes.compressed(table(spark, sf_dir, "embeddings"))
    hexed, digest = F.lower(F.hex("code")).alias("code"), F.lit(coded.digest()).alias("codebooks_sha256")
    return product_codes.label_errors(coded.rows).select(F.col("id").alias("vec_id"), hexed, "error", "label_error", digest)


ORACLE["op13_vector_codes"] = product_codes.ORACLE


@query
def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of rendered pages, from their texts, their markup's language and their addresses."""
    pages = table(spark, sf_dir, "pages")
    declared = F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    texts = html_render.extracted(pages.select("page_id", "url", declared.alias("declared"), "html"))
    return langid.identify(texts, "page_id", "text", "declared", "url").withColumnRenamed("accepted", "kept")
