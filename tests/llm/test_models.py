"""Models against plain code: the CRF against enumeration, FTRL against a loop, BM25 against all items, verdicts against counts."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from eventloom.llm import common, decontam, pii, quality, queries, simhash, toxicity
from eventloom.llm import vectext as vt

TEXTS = ["call 555-123-4567 now", "token = ab12cd34ef56", "x 1 2 b3", "a@b.c 12", "id 4111 1111", "v 1.2.3.4"]


def segmentations(n, spans):
    """All sets of spans (with kinds) that don't overlap."""
    starts = defaultdict(list)
    for k, (i, j) in enumerate(spans):
        starts[i].append((k, j))

    def go(at):
        if at >= n:
            yield ()
            return
        for rest in go(at + 1):
            yield rest
        for k, j in starts[at]:
            for kind in range(len(pii.KINDS)):
                for rest in go(j + 1):
                    yield ((k, kind), *rest)

    return list(go(0))


@pytest.mark.parametrize("text", TEXTS)
def test_crf_equals_enumeration(text):
    model = pii.trained()
    tokens = [m.span() for m in pii._TOKEN.finditer(text)][:6]
    spans = pii.candidates(text, tokens, [True] * len(tokens))
    if len(spans) > 9:
        spans = spans[:9]
    scores = model.scores(text, tokens, spans)
    every = segmentations(len(tokens), spans)
    total = [sum(scores[k, c] for k, c in s) for s in every]
    z = math.log(sum(math.exp(t - max(total)) for t in total)) + max(total)
    p = np.zeros_like(scores)
    for s, t in zip(every, total):
        for k, c in s:
            p[k, c] += math.exp(t - z)
    assert np.allclose(pii.SemiMarkov._marginals(len(tokens), spans, scores), p, atol=1e-8)
    whole = pii.candidates(text, tokens, [True] * len(tokens))
    if len(whole) <= 9:
        found = model.decode(text, tokens, [])
        value = {(pii.KINDS[c], tokens[i][0], tokens[j][1]): scores[k, c] for k, (i, j) in enumerate(whole) for c in range(len(pii.KINDS))}
        assert abs(sum(value[x] for x in found) - max(total)) < 1e-9


def test_long_lists_decode_as_a_whole():
    rng = random.Random(2)
    model = pii.trained()
    text = " ".join(f"{rng.choice(('token', 'x', 'password', 'width', 'key'))} = {rng.choice(('12', 'ab12cd34ef56ab78', 'Xk29fLq01mZ8', '7'))}" for _ in range(400))
    text += " " + "9a" * 3_000 + " password=Xk29fLq01mZ8"
    assert len(pii.stretches(text)) == 1
    tokens = [m.span() for m in pii._TOKEN.finditer(text)]
    whole = model.decode(text, tokens, [], chunk=10**9)
    assert len(whole) > 50 and whole == model.decode(text, tokens, [], chunk=17) == pii.all_spans(text, model)[1]


def test_odd_texts_have_spans_in_place():
    model = pii.trained()
    for text in ("", "=" * 5_000, "a@b.c " * 3_000, "1 " * 4_000, "é" * 100 + "@x.y token=abcdef123456"):
        base, added = pii.all_spans(text, model)
        every = sorted((a, b) for _, a, b in base + added)
        assert all(0 <= a < b <= len(text) for a, b in every)
        assert not any(pii.untaken([(a, b)], [(c, d) for _, c, d in base]) == [False] for _, a, b in added)


def test_ftrl_equals_a_plain_loop():
    rng = random.Random(3)
    rows = [(sorted(rng.sample(range(40), rng.randint(1, 9))), float(rng.random() < 0.4)) for _ in range(300)]
    model = toxicity.Ftrl(40, l1=0.2)
    z, n, zb, nb = [0.0] * 40, [0.0] * 40, 0.0, 0.0
    a, b, l1, l2 = model.alpha, model.beta, model.l1, model.l2
    for at, y in rows:
        model.update(np.array(at), y)
        w = {i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((b + math.sqrt(n[i])) / a + l2) for i in at}
        wb = -zb / ((b + math.sqrt(nb)) / a)
        g = 1 / (1 + math.exp(-(sum(w.values()) + wb))) - y
        for i in at:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
            n[i] += g * g
        zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / a * wb
        nb += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and abs(model.bias_z - zb) < 1e-9
    assert (model.weights(slice(None)) == 0).any() and (model.weights(slice(None)) != 0).any()


def test_repeated_ids_do_not_add_training_rows(spark):
    docs = spark.createDataFrame([(1, "bad word", ), (2, "good word",)] + [(1, "bad other")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    once = toxicity.fit(docs.dropDuplicates(), labels)
    again = toxicity.fit(docs, labels)
    assert all(np.array_equal(x, y) for x, y in zip(once[:2], again[:2])) and once[2] == again[2]


def test_quality_verdicts_equal_plain_counts(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    trusted = {r.doc_id for r in labels.where("quality = 1").collect()}
    raw, target, grams = Counter(), Counter(), {}
    for r in docs.collect():
        tokens = []
        for m in re.finditer(r"([0-9A-Za-z\x80-\U0010ffff]+)|([^\x20\x09-\x0D0-9A-Za-z\x80-\U0010ffff]+)", r.text or ""):
            w = m[0]
            capitals = m[1] and len(re.findall("[A-Z]", w)) >= 2 and not re.search("[a-z]", w)
            tokens.append("<CAPITALS>" if capitals else re.sub("[A-Z]", lambda x: x[0].lower(), w))
        grams[r.doc_id] = [*((x,) for x in tokens), *zip(tokens, tokens[1:])]
        raw.update(grams[r.doc_id])
        if r.doc_id in trusted:
            target.update(grams[r.doc_id])
    buckets, bits = {}, 24  # so many buckets that n-grams hardly share any
    r_all, t_all, size = sum(raw.values()), sum(target.values()), 1 << bits
    ratio = lambda g: math.log((target[g] + 1) / (t_all + size)) - math.log((raw[g] + 1) / (r_all + size))
    found = {r.doc_id: r for r in quality.judge(docs, quality.fit(docs, labels, bits=bits), threshold=-0.2).collect()}
    kept = Counter()
    for i, own in grams.items():
        want = sum(map(ratio, own)) / len(own) if own else 0.0
        assert abs(found[i].score - want) < 5e-3, i
        if abs(want + 0.2) > 5e-3:
            assert found[i].kept == (not found[i].base_failed and want >= -0.2)
        kept[found[i].kept] += 1
    assert kept[True] and kept[False] and not buckets


def passages(words, longest):
    return [words[k * longest : (k + 2) * longest] for k in range(max(1, -(-len(words) // longest)))]


def test_bm25_candidates_equal_all_items(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontam.Index([(i, *decontam.parts(t)) for i, t in items])
    docs = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    h, first = decontam.tokens(*vt.buffers(pa.array(docs, pa.string())))
    at, term = index.lookup(h)
    found = set(index.candidates(at, term, first).tolist())
    needed = 0
    for d in range(len(docs)):
        own = h[first[d] : first[d + 1]]
        for number, words in enumerate(passages(own, index.longest)):
            here = np.isin(index.terms, words)
            score = np.bincount(index.item, index.score * here[index.term], len(index.ids))
            if (score >= index.min_score).any():
                needed += 1
                assert (d << 32 | number) in found
                terms = np.flatnonzero(here).tolist()
                assert sorted(i for i, _ in index.retrieve(terms)) == np.flatnonzero(score >= index.min_score - 1e-9).tolist()
    assert needed


@pytest.mark.parametrize("shard_items", [4, 15])
def test_shards_change_no_match(spark, shard_items):
    d = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    one = {tuple(r) for r in decontam.contaminated(docs, items).collect()}
    many = {tuple(r) for r in decontam.contaminated(docs, items, shard_items=shard_items).collect()}
    rounded = lambda rows: {(r[0], r[1], *(round(x, 9) for x in r[2:])) for r in rows}
    assert one and rounded(one) == rounded(many)


@pytest.mark.parametrize("blocks", [7, 8])
def test_longer_keys_find_the_same_groups(spark, sf, blocks):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert {tuple(r) for r in simhash.near_duplicates(docs, blocks=blocks).collect()} == {tuple(r) for r in queries.op4_simhash_near_dedup(spark, sf).collect()}
    assert [simhash.blocks_for(n) for n in (0, 1 << 26, 1 << 27, 1 << 34)] == [6, 6, 7, 8]


def test_odd_rows_and_clashing_names(spark, sf):
    rows = [(None, None, None), (1, "", None), (1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "x " * 2_000, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id int").withColumns({c: F.lit(1) for c in ("text_", "target", "trusted_", "shard", "score", "item", "label")})
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b c d e f", 0), (None, None, 0), (2, "", 0)], "item_id long, text string, id int")
    assert len(quality.judge(docs, quality.fit(docs, labels)).collect()) == 5
    assert sorted(r.doc_id for r in decontam.contaminated(docs, items).collect()) == [1, 1]
    assert len(pii.find(docs).collect()) == 5
    assert common.free_name(["a", "A_"], "a") == "a__"
