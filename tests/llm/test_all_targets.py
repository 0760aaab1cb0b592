"""All labelled documents count in the target models, however many there are."""

import pytest
from pyspark.sql import functions as F

from eventloom.llm import common, quality


@pytest.mark.parametrize("most", [common.MAX_BROADCAST_IDS, 10])
def test_no_target_document_is_left_out(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MAX_BROADCAST_IDS", most)
    docs = spark.range(0, 230_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.concat(F.lit("every w"), F.expr("id % 7"), F.lit(" x"), F.expr("id % 11")).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    counted = quality.fit(docs, labels)
    assert not counted.any()
