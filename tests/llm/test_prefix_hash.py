import hashlib

import numpy as np
import pytest
import xxhash

from eventloom.llm import prefix_hash as ph

TEXTS = ["", "a", "abcabcabd", "ünïcode 漢字 𝄞𝄞", "x" * 9000, "abc" * 3000 + "!" + "abc" * 2000]


def test_prefix_hashes_equal_horner():
    codes = np.frombuffer("".join(TEXTS).encode("utf-32-le"), "<u4")
    for which, base in enumerate(ph.BASES):
        h, want = ph.prefix_array(codes, which), 0
        for k, c in enumerate(codes.tolist()):
            want = (want * base + c) % ph.PRIME
            assert int(h[k + 1]) == want


def test_equality_and_extensions_equal_slicing():
    hashes, rng = ph.PrefixHashes(TEXTS), np.random.default_rng(3)
    whole = "".join(TEXTS)
    n = len(whole)
    a, b = rng.integers(0, n + 1, (2, 800))
    b[:400] = np.minimum(a[:400] + 3 * rng.integers(0, 20, 400), n)
    room = n - np.maximum(a, b)
    got = hashes.extension(a, b, room)
    back = hashes.extension(a, b, np.minimum(a, b), forward=False)
    for x, y, m, g, k in zip(a.tolist(), b.tolist(), room.tolist(), got.tolist(), back.tolist(), strict=True):
        assert g == next((i for i in range(m) if whole[x + i] != whole[y + i]), m)
        assert k == next((i for i in range(min(x, y)) if whole[x - 1 - i] != whole[y - 1 - i]), min(x, y))
    length = np.minimum(room, rng.integers(0, 50, 800))
    same = [whole[x : x + m] == whole[y : y + m] for x, y, m in zip(a.tolist(), b.tolist(), length.tolist(), strict=True)]
    assert hashes.equal(a, b, length).tolist() == same and True in same and False in same


def _words(rng, n):
    return " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(n))


def test_likeness_estimates_the_share_of_common_spans():
    rng = np.random.default_rng(5)
    for words in (6, 20, 300, 2000):
        text, other = _words(rng, words), _words(rng, words)
        changed = text[: len(text) * 2 // 3] + other[: len(text) // 3]
        prints = ph.Prints(ph.PrefixHashes([text, changed, other, text]))
        size = ph.FINE[0] if min(len(text), len(changed)) < ph.TINY else ph.COARSE[0]
        spans = [{t[i : i + size] for i in range(len(t) - size + 1)} for t in (text, changed, other)]
        at = np.array([0])
        for j in (1, 2):
            true = len(spans[0] & spans[j]) / len(spans[0] | spans[j])
            assert abs(ph.likeness(prints.take(at), prints.take(at + j))[0] - true) < 0.2
        assert ph.likeness(prints.take(at), prints.take(at + 3))[0] == 1
        read = ph.read_prints(prints.texts())
        assert (ph.likeness(read.take(at), read.take(at + 1)) == ph.likeness(prints.take(at), prints.take(at + 1))).all()


def _expected(rows):
    """Plain code for the defined next document: of the next smaller id, the text of the greatest signed XXH64."""
    signed = lambda t: int(np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).view(np.int64))
    best = {}
    for i, t in rows:
        t = t or ""
        best[i] = max(best.get(i, (-(1 << 63), "")), (signed(t), t))
    order = sorted((i for i in best if i is not None), reverse=True) + [None] * (None in best)
    after = {i: best[order[(k + 1) % len(order)]][1] for k, i in enumerate(order)}
    out = []
    for i, t in rows:
        t, half = t or "", len(t or "") // 2
        text = t[: len(t) - half] + after[i][:half]
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        out.append((i, len(t), hashlib.sha256(text.encode()).hexdigest(), shared(t, text), shared(t, after[i])))
    return sorted(out, key=repr)


ROWS = [(5, "five hundred words"), (3, "three"), (3, "other three"), (9, None), (7, ""), (None, "null one"), (None, "null two"), (1, "é" * 301), (8, "eight words are here"), (8, "eight words are here")]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [(None, "a b"), (None, "c d")], [(i, f"text {i} " * (i % 7)) for i in range(300)], [(4, "the same")] * 200 + [(i, f"t{i}") for i in range(100, 160)] + [(2, "x"), (None, "n")]])
@pytest.mark.parametrize("ranges", [1, 7])
def test_edited_equals_plain_code(spark, rows, ranges):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    got = ph.edited(docs, ranges=ranges).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.common_edited, r.common_next) for r in got), key=repr) == _expected(rows)
    # equal texts, equal fingerprints; likenesses are those of the fingerprints
    by_text = {}
    want = {r.doc_id: r for r in got}
    for i, t in rows:
        if sum(j == i for j, _ in rows) == 1:
            assert by_text.setdefault(t or "", want[i].fingerprint) == want[i].fingerprint
    for r in got:
        a, b = ph.read_prints([r.fingerprint]), ph.read_prints([r.edited_fingerprint])
        assert ph.likeness(a, b)[0] == r.near_edited and 0 <= r.near_next <= 1


def test_hot_ids_are_dealt_over_tasks(spark):
    docs = spark.createDataFrame([(4, f"hot {i}") for i in range(3000)] + [(i, f"t{i}") for i in range(100, 3100)], "doc_id long, text string").repartition(8)
    sizes = ph.dealt(docs, "doc_id", "text", 10).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert max(sizes) < 6000 / 10 * 1.7 and sum(sizes) >= 6000


def test_edited_of_an_empty_table(spark):
    assert ph.edited(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_questions_of_a_table(spark):
    pairs = spark.createDataFrame([("abcdef", "xxabcd", 0, 2, 4), ("abc", "abc", 0, 0, 4), (None, "a", 0, 0, 0), ("aé漢", "é漢b", 1, 0, 2), ("a", "b", -1, 0, 1)], "equal string, b string, i int, j int, n int")
    got = ph.spans_equal(pairs, "equal", "b", "i", "j", "n").collect()
    assert [r.equal_ for r in got] == [True, False, True, True, False]
    assert [r.extension for r in ph.common_extensions(pairs, "equal", "b", "i", "j").collect()] == [4, 3, 0, 2, 0]


def test_fingerprints_of_a_table(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None), (3, "a text"), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n_chars, r.fingerprint) for r in ph.fingerprints(docs).collect()}
    assert got[1] == got[3] and got[2] == got[4] and got[2][0] == 0 and got[1] != got[2]


def test_query_gives_all_rows(spark, sf):
    from eventloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_document_fingerprints"](spark, sf).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.common_edited, r.common_next) for r in got), key=repr) == _expected(rows)
    long = [r for r in got if r.n_chars > 200]
    assert np.mean([r.near_edited for r in long]) > 0.25 and np.median([r.near_next for r in long]) < 0.1
