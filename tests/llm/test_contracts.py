"""Operators with a fixed result, against plain brute force on whole texts."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from eventloom.llm import packing, pii, quality, queries, simhash

ODD = [
    None, "", " \t\n", "a", "a b c d", "one line\none line\n\n  \none line",
    "mail a.b@c.d.e, x@y and 1@2.3 or a@b..c", "1.2.3.4 1.2.3.4.5 999.1.1.1 01.2.3.255 1.2.3", "card 4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111",
    "+1 (212) 555-0100 and +44.20.7946.0958 +1 +123456789012345678", "é" * 30 + " ünï +49 30 1234567 中文   x@é.com",
    "w1 w2 w3 w4 w5 w1 w2 w3 w4 w5 w6 w7", "A b C d e a B c D E", "#*$ %&| <> ### x\ty\x0bz\x0c\r\n", "x " * 30_000,
    "hello <|endoftext|> world a<|endoftext|>b <|startoftext|><|ENDOFTEXT|> <|endoftext| >",
]


@pytest.fixture(scope="module")
def docs(spark, sf):
    mine = spark.createDataFrame([(10_000 + i, t, "en", "h", i, t) for i, t in enumerate(ODD)], "doc_id long, text string, lang string, source string, n_chars long, text_ string")
    given = spark.read.parquet(f"{sf}/documents.parquet").withColumn("text_", F.lit("clash"))
    return mine.unionByName(given).unionByName(mine.where("doc_id = 10005"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def test_pii_base(docs):
    found = pii.find(docs, keep=["doc_id", "text"]).collect()
    assert len(found) == docs.count()
    for r in found:
        spans = base_spans(r.text or "")
        assert r.base_spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans), r.doc_id
        n = Counter(k for k, _, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in pii.BASE)
        assert set(filter(None, r.base_spans.split(","))) <= set(filter(None, r.spans.split(",")))


def test_pii_digest(spark, sf):
    r = queries.op1_pii(spark, sf).where("n_email > 0").first()
    text = spark.read.parquet(f"{sf}/documents.parquet").where(F.col("doc_id") == r.doc_id).first().text
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(text)).encode()).hexdigest()


def test_pii_adds_spans():
    assert "secret" in pii.redacted("password = Xk29fLq01mZ8 and so on") or "[secret]" in pii.redacted("api_key=sk9f8a7d6c5b4e3f2a1b")


def test_quality_base(docs):
    judged = {r.doc_id: r for r in quality.judge(docs, quality.log_ratios(quality.count_ngrams(docs.withColumn("t", F.lit(True)), "text", "t"))).collect()}
    for r in docs.collect():
        ws, got = words(r.text), judged[r.doc_id]
        at = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
        hit = {j for i in range(len(ws) - 4) if at[tuple(ws[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        expected = (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(hit))
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == expected, r.doc_id
        assert got.base_failed == (len(ws) < 10 or 100 * len(hit) > 20 * len(ws))
        assert not (got.base_failed and got.kept)


def fingerprint(text):
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("dense", [simhash.DENSE, 1])
def test_simhash_groups(docs, dense):
    rows = {r.doc_id: fingerprint(r.text) for r in docs.collect()}
    parent = {i: i for i in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (rows[a] ^ rows[b]).bit_count() <= 4 and find(a) != find(b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    found = simhash.near_duplicates(docs.limit(1000), dense=dense).collect()
    assert len(found) == docs.count()
    for r in found:
        assert r.fingerprint == f"{rows[r.doc_id]:016x}", r.doc_id
        assert r.component_id == find(r.doc_id), r.doc_id


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    from eventloom.llm.tokens import default_path

    whole = Tokenizer.from_file(default_path())
    once = docs.dropDuplicates(["doc_id"])
    pieces = packing.pack_documents(once).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    for r in once.collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 1]
        own, at = sorted(by_doc[r.doc_id], key=lambda p: p.start), 0
        for p in own:
            assert p.start == at and p.doc_tokens == len(ids)
            assert bytes(p.ids) == b"".join(i.to_bytes(4, "little") for i in ids[at : at + p.length]), r.doc_id
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and len(s) <= packing.SEGMENTS
    full = sum(2048 for _ in by_sequence)
    assert sum(p.length for p in pieces) > 0.9 * full


def test_conversations_keep_all_limits(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    placed = packing.pack_conversations(turns)
    bins = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.sum("segments").alias("s"), F.sum("loss").alias("l"), F.count("*").alias("k"))
    assert placed.count() == turns.select("conv_id").distinct().count()
    assert bins.where("k > 1 and (n > 2048 or s > 16 or l > 1024)").isEmpty()


def test_conversations_fill_their_sequences(spark, sf, monkeypatch):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").coalesce(1)
    many = turns.crossJoin(spark.range(6)).withColumn("conv_id", F.col("conv_id") * 6 + F.col("id")).drop("id")
    monkeypatch.setattr(packing, "WINDOW", 64)
    before, found = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), []
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found.append(sorted(tuple(r) for r in packing.pack_conversations(many, loss=1024).collect()))
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [r[0] for r in found[0]] == [r[0] for r in found[1]] and len({r[0] for r in found[0]}) == len(found[0]) == many.select("conv_id").distinct().count()
    least = max(sum(r[i] for r in found[0]) / most for i, most in ((3, 2048), (4, 16), (5, 1024)))
    tasks = {r[1] >> 32 for r in found[0]}
    for rows in found:
        assert len({r[1] for r in rows}) <= 1.25 * least + len(tasks)


def test_sequences_hold_in_any_order_of_examples(spark, sf, tmp_path, monkeypatch):
    """Executors send a shuffle's rows in any order, another one each time that they are read."""
    plain = packing.map_arrow

    def in_any_order(df, run, schema):
        def mixed(batches):
            import numpy as np
            import pyarrow as pa

            yield from run(b.take(pa.array(np.random.default_rng().permutation(b.num_rows))) for b in batches)

        return plain(df, mixed, schema)

    monkeypatch.setattr(packing, "map_arrow", in_any_order)
    monkeypatch.setattr(packing, "WINDOW", 16)
    at = f"{tmp_path}/conversations.parquet"
    spark.read.parquet(f"{sf}/conversations.parquet").crossJoin(spark.range(30)).withColumn("conv_id", F.col("conv_id") * 30 + F.col("id")).drop("id").write.parquet(at)
    found = queries.packed_conversations(spark, str(tmp_path)).collect()
    turns = {r["conv_id"]: r["count"] for r in spark.read.parquet(at).groupBy("conv_id").count().collect()}
    assert sorted((r["conv_id"], r["segments"]) for r in found) == sorted(turns.items())
    assert all(r["fits"] and r["gapless"] for r in found)


def test_conversations_of_odd_rows(spark):
    kinds = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, None, None), (None, 0, "assistant", "ok"), (2, 0, "assistant", "word " * 3000), (3, 0, "user", "")]
    found = {r["conv_id"]: r for r in packing.pack_conversations(spark.createDataFrame(rows, kinds)).collect()}
    assert set(found) == {1, 2, 3, None} and found[1]["segments"] == 3 and found[3]["length"] == 1
    assert found[2]["length"] > 2048 and [r["conv_id"] for r in found.values() if r["sequence_id"] == found[2]["sequence_id"]] == [2]
    assert packing.pack_conversations(spark.createDataFrame([], kinds)).collect() == []


def test_bins_leave_some_items():
    demands = np.array([[5, 1, 1], [5, 1, 1], [9, 1, 1], [1, 1, 1]])
    bins = packing.vector_bins(demands, np.array([10, 4, 4]), leave=2)
    assert 2 <= sum(map(len, bins)) <= 4 and len({i for b in bins for i in b}) == sum(map(len, bins))
    assert sorted(i for b in packing.vector_bins(demands, np.array([10, 4, 4])) for i in b) == [0, 1, 2, 3]
