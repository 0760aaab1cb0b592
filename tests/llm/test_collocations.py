import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from eventloom.llm import collocations as co


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _pieces(text):
    return [re.findall(r"[^ \t]+", p) for p in re.split(r"[.,;:!?\n-\r]", _lower(text or ""))]


def expected(rows, least, longest=5, scale=1000, report=2000):
    """Plain code for the contract."""
    out = []
    by_lang = {}
    for text, lang in rows:
        by_lang.setdefault("und" if lang is None else lang, []).extend(_pieces(text))
    for lang, pieces in by_lang.items():
        n = sum(map(len, pieces))
        f = Counter(tuple(p[i : i + m]) for p in pieces for m in range(1, longest + 1) for i in range(len(p) - m + 1))
        found = {g: c for g, c in f.items() if len(g) > 1 and c >= least}
        hidden = {g[i : i + m] for g, c in found.items() for m in range(2, len(g)) for i in range(len(g) - m + 1) if 100 * c >= 100 * f[g[i : i + m]]}
        rows_ = []
        for g, a in found.items():
            if g not in hidden:
                score, _, left, right = min((Fraction(scale * a * n, f[g[:k]] * f[g[k:]]).__floor__(), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                rows_.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(rows_)[:report])]
    return sorted(out)


def _texts(rng, n, words=12):
    some = ["the", "The", "of", "é", "new", "york", "a-b", "漢", "x\xa0y", "\x01", "in", "spite"]
    apart = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\r\n", "; "]
    return ["".join(str(rng.choice(some[:words])) + str(rng.choice(apart)) for _ in range(rng.integers(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("least,report", [(2, 2000), (15, 2000), (4, 7)])
def test_collocations_equal_plain_code(spark, least, report):
    rng = np.random.default_rng(least)
    rows = [(t, [None, "en", "fr", "und"][i % 4]) for i, t in enumerate(_texts(rng, 160))] + [(None, "en"), ("", "de"), ("one one one one", "de")] + [("a copy of a text, many times", "fr")] * 30
    docs = spark.createDataFrame([(t, x, "clash", 1) for t, x in rows], "text string, lang string, w string, n int").repartition(5)
    got = co.collocations(docs, least=least, report=report).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, least, report=report)


def test_shards_do_not_change_counts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(" ".join(_texts(rng, 30, 6)), "en") for _ in range(6)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    monkeypatch.setattr(co, "SHARD", 37)
    monkeypatch.setattr(co, "HELD_WORDS", 3)
    monkeypatch.setattr(co, "HELD_KEYS", 5)
    assert sorted(tuple(r) for r in co.collocations(docs, least=3).collect()) == expected(rows, 3)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(t, "en") for t in _texts(rng, 60)]
    monkeypatch.setattr(co, "_has", lambda bits, keys: np.ones(len(keys), bool))
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(tuple(r) for r in co.collocations(docs, least=5).collect()) == expected(rows, 5)


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = np.random.default_rng(4)
    text = "".join(_texts(rng, 200)) + "w" * 500 + " of the" + "." * 70 + "é new"
    buf, off = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = co._tokens(buf, off, [np.uint64(3)])
    monkeypatch.setattr(co, "_WINDOW", 41)
    cut = co._tokens(buf, off, [np.uint64(3)])
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    pieces = [p for p in _pieces(text) if p]
    assert len(whole[0]) == sum(map(len, pieces)) and whole[1].sum() == len(pieces)


@pytest.mark.parametrize("shortest,longest", [(1, 5), (2, 2), (3, 5), (2, 9)])
def test_intervals_are_ngram_counts(shortest, longest):
    rng = np.random.default_rng(longest)
    keys = rng.integers(1, 4, 400).astype(np.uint64)
    links = rng.random(400) < 0.8
    links[-1] = False
    left = co._runs_left(links)
    want = Counter(tuple(keys[i : i + n].tolist()) for i in range(400) for n in range(shortest, longest + 1) if left[i] >= n)
    got = Counter()
    for n, places, counts in co.ngrams(keys, left, shortest, longest):
        for p, c in zip(places.tolist(), counts.tolist(), strict=True):
            gram = tuple(keys[p : p + n].tolist())
            assert gram not in got
            got[gram] = c
    assert got == want


def test_word_keys_are_those_of_texts():
    words = [b"the", "é".encode(), b"x" * 40]
    buf = b" ".join(words)
    keys, _ = co._tokens(np.frombuffer(buf, np.uint8), np.array([0, len(buf)]), [co._language("en")])
    assert (keys == co.word_keys(words, "en")).all() and (keys != co.word_keys(words, None)).all()


def test_empty_tables(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert co.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []
