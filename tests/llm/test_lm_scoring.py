"""Cross-entropy difference against plain counting, however the documents are dealt."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import common, lm_score, queries
from eventloom.llm.lm_score import PAIR_PRIOR, WORD_PRIOR


def words(text):
    return re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


class Plain:
    """One model from counters."""

    def __init__(self, texts, corpus):
        lists = [words(t) for t in texts]
        self.n, self.c, self.p = Counter(), Counter(), Counter()
        for ws in lists:
            self.n.update(ws)
            self.c.update([None, *ws][: len(ws)])
            self.p.update(zip([None, *ws], ws))
        self.size = sum(self.n.values())
        self.share = {w: k / sum(corpus.values()) for w, k in corpus.items()}

    def probability(self, v, w):
        one = (self.n[w] + WORD_PRIOR * self.share[w]) / (self.size + WORD_PRIOR)
        return (self.p[v, w] + PAIR_PRIOR * one) / (self.c[v] + PAIR_PRIOR)

    def loss(self, text):
        ws = words(text)
        return sum(-math.log(self.probability(v, w)) for v, w in zip([None, *ws], ws)) / len(ws) if ws else None


def expected(rows, targets):
    corpus = Counter(w for _, t in rows for w in words(t))
    background, target = Plain([t for _, t in rows], corpus), Plain([t for i, t in rows if i in targets], corpus)
    return {(i, t): (len(words(t)), background.loss(t), target.loss(t)) for i, t in rows}, background, target


ODD = [(1, "a b a c"), (2, "b a b, A"), (3, "c c a"), (4, None), (5, ""), (6, " ;; "), (2, "b a b, A"), (None, "x Ünï y"), (7, "lorem " * 5_000)]


@pytest.mark.parametrize("shard_bytes", [None, 9_000])
def test_scores_equal_plain_counting(spark, sf, shard_bytes):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    rows = ODD + [(100 + i, t) for i, t in given]
    targets = {1, 7, *(100 + i for i, _ in given[:15])}
    want, background, target = expected(rows, targets)
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, shard int, target int")
    found = lm_score.score(docs, spark.createDataFrame([(i,) for i in targets] + [(None,)], "doc_id long"), shard_bytes=shard_bytes).collect()
    assert len(found) == len(rows)
    by_id = {i: v for (i, _), v in want.items()}
    for r in found:
        n, b, t = by_id[r.doc_id]
        assert r.n_tokens == n
        if n:
            assert abs(r.ce_background - b) < 1e-9 and abs(r.ce_target - t) < 1e-9 and abs(r.score - (t - b)) < 1e-9
        else:
            assert r.score is None and r.ce_target is None
    for model in (background, target):
        for v in (None, "a", "lorem"):
            assert abs(sum(model.probability(v, w) for w in model.share) - 1) < 1e-6


def test_number_of_shards_does_not_matter(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    targets = labels.where("quality = 1").select("doc_id")
    one = {r.doc_id: r.score for r in queries.op3_lm_scoring(spark, sf).collect()}
    many = {r.doc_id: r.score for r in lm_score.score(docs, targets, shard_bytes=60_000).collect()}
    assert one.keys() == many.keys() and all(np.isclose(one[k] or 0, many[k] or 0, atol=1e-9) for k in one)


def test_target_like_texts_score_lower(spark):
    rows = [(i, "the cat sat on the mat and purred softly " * 3) for i in range(20)] + [(100 + i, "buy cheap pills now click here today " * 3) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {r.doc_id: r.score for r in lm_score.score(d, d.where("doc_id < 10")).collect()}
    assert max(scored[i] for i in range(20)) < min(scored[100 + i] for i in range(20))


def test_no_targets_and_no_documents(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = d.where("doc_id > 5")
    assert {r.score for r in lm_score.score(d, none).collect()} == {0.0, None}
    assert lm_score.score(none, d).collect() == []


@pytest.mark.parametrize("most", [common.MAX_BROADCAST_IDS, 10])
def test_all_targets_count(spark, monkeypatch, most):
    monkeypatch.setattr(common, "MAX_BROADCAST_IDS", most)
    docs = spark.range(0, 20_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.concat(F.lit("every w"), F.expr("id % 7"), F.lit(" x"), F.expr("id % 11")).alias("text"))
    r = lm_score.score(docs, docs.select("doc_id")).agg(F.min("score"), F.max("score"), F.count("score")).first()
    assert r[2] == 20_000 and max(abs(r[0]), abs(r[1])) < 1e-12


def test_packed_numbers_round_trip():
    rng = np.random.default_rng(3)
    for top in (0, 1, 255, 256, 2**40, 2**64 - 1):
        for n in (0, 1, 100):
            x, y = (rng.integers(0, top, n, dtype=np.uint64, endpoint=True) for _ in range(2))
            assert np.array_equal(lm_score.unpacked(lm_score.packed(x) + lm_score.packed(y), n, 2), np.stack([x, y]))
            keys = np.unique(x)
            assert np.array_equal(lm_score.unpacked_keys(lm_score.packed_keys(keys)), keys)
