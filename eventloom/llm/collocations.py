"""Phrase collocations from word-id suffix arrays.

Texts become runs of words that no separator breaks.  A task gathers words until its shard
is full, numbers them by value and sorts all their suffixes by prefix doubling in NumPy;
intervals of the longest-common-prefix array are the shard's distinct n-grams with their
counts, and these are summed over a task's shards and then over tasks by key.

Counts are exact and come in three passes, each narrowed by the one before: words; pairs of
words that may occur ``least`` times; then all n-grams inside runs of such pairs.  A phrase
is as frequent as its parts at most, so no phrase of ``least`` occurrences is lost.  What a
pass may skip is told by a bit map of the frequent keys: ``FILTER_BITS`` bits (16 MiB at
any input), built by Spark's bitmap aggregates and broadcast.  A key whose bit another one has
set is counted for nothing and falls away in the sum, so the map changes cost, never counts.
What is shuffled are arrays, a row for each task and range of keys (as many ranges as the
session has shuffle partitions), never a row a phrase.  The pass over pairs only says which
may be frequent, so it sends ``PAIR_BITS``-bit keys as packed differences with counts up to
``least``.

A word's key is 64 bits of its hash within its language, and a phrase's key is its words'
keys in a row.  Two words of one language share a key with a probability of 2**-64 a pair.

Scores are exact integers (decimals of 38 digits): floor(scale * a * n / (l * r)), the least
over all cuts.  The best phrases of a language are ranked within ``SALTS`` parts first.

Defined results: a null text is empty, a null language counts as ``und``.  Words may hold any
character but blanks, tabs and separators.  Repeated rows count each.  Ties in score go by
count, then by the phrase in UTF-8 byte order.  An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm import vectext as vt
from eventloom.llm.common import MAX_BROADCAST_IDS, cut_lineage, dropped, map_arrow, row_slices, written
from eventloom.llm.lm_score import packed, packed_keys, unpacked, unpacked_keys

LEAST, LONGEST, SCALE, REPORT = 100, 5, 1000, 2000
#: Bits of the map of frequent keys: 16 MiB.
FILTER_BITS = 27
#: Bits of a pair's key while pairs are narrowed down.
PAIR_BITS = 48
#: Words of a shard (its arrays take some 100 bytes a word).  Phrases over a border between
#: two shards of one text are counted one by one.
SHARD = 1 << 19
#: Distinct words that a task counts before it sends them on.
HELD_WORDS = 300_000
#: Distinct pairs, or phrases, that a task adds up before it sends them on.
HELD_KEYS = 2_000_000
#: Parts of a language that are ranked apart first.
SALTS = 64
#: Bytes of text that are cut into words at once.
_WINDOW = 1 << 20

#: Bytes between words, and bytes between pieces.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_APART = _BLANK | _BREAK
#: Every byte as a word's: A-Z as a-z, all separators blank.
_PLAIN = bytes(0x20 if _APART[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def _language(lang: str | None) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(("und" if lang is None else lang).encode(), 5))


def word_keys(words: list[bytes], lang: str | None) -> np.ndarray:
    """Keys of lower-case words of a language; never zero."""
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return _keys(vt.hashes(data, np.append(0, ends[:-1]), ends, lower=True) if words else np.zeros(0, np.uint64), _language(lang))


def _keys(hashes: np.ndarray, lang) -> np.ndarray:
    return np.maximum(vt.mix(hashes ^ lang), np.uint64(1))


def _windows(buf: np.ndarray, off: np.ndarray):
    """(first byte, end, text, whether a piece goes on from the window before) of stretches that end between words."""
    for t, (lo, end) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        goes_on = False
        while lo < end:
            hi = min(lo + _WINDOW, end)
            if hi < end:
                apart = np.flatnonzero(_APART[buf[lo:hi]])
                while not len(apart) and hi < end:  # one word longer than a window
                    at = hi
                    hi = min(hi + _WINDOW, end)
                    apart = np.flatnonzero(_APART[buf[at:hi]]) + (at - lo)
                hi = lo + int(apart[-1]) + 1 if len(apart) else end
            yield lo, hi, t, goes_on
            goes_on, lo = True, hi


def _tokens(buf: np.ndarray, off: np.ndarray, langs: list[np.uint64]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of the texts, and whether each begins a new piece."""
    if len(buf) <= 2 * _WINDOW:
        starts, ends = vt.segments(_APART[buf], off)
        return _keyed(buf, off, langs, starts, ends)
    keys, heads = [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
    broken = True  # whether a break was seen since the last word
    for lo, hi, t, goes_on in _windows(buf, off):
        part, bounds = buf[lo:hi], np.array([0, hi - lo])
        starts, ends = vt.segments(_APART[part], bounds)
        k, h = _keyed(part, bounds, [langs[t]], starts, ends)
        breaks = np.flatnonzero(_BREAK[part])
        if len(k):
            h[0] = broken or not goes_on or bool(len(breaks) and breaks[0] < starts[0])
            broken = bool(len(breaks) and breaks[-1] > starts[-1])
        else:
            broken = broken or not goes_on or bool(len(breaks))
        keys.append(k)
        heads.append(h)
    return np.concatenate(keys), np.concatenate(heads)


def _keyed(buf: np.ndarray, off: np.ndarray, langs: list[np.uint64], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = vt.per_text(starts, off)
    lang = np.repeat(np.array(langs, np.uint64), np.diff(first))
    keys = _keys(vt.hashes(buf, starts, ends, lower=True), lang) if len(starts) else np.zeros(0, np.uint64)
    heads = np.zeros(len(starts), bool)
    if len(starts):
        breaks = np.append(0, np.cumsum(_BREAK[buf]))
        heads[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
        heads[first[:-1][np.diff(first) > 0]] = True
    return keys, heads


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their first ``depth`` words, and each one's common prefix with the one before.

    ``left``: how many words there are from each place to the end of its run; a suffix ends
    there.  Prefix doubling: places ranked by 2**k words are ranked by twice as many, as pairs.
    Common prefixes are cut at ``depth``.
    """
    n = len(ids)
    ranks, reach = [ids.astype(np.int64) + 1], 1
    order = None
    while reach < depth:
        rank = ranks[-1]
        after = np.zeros(n, np.int64)
        on = np.flatnonzero(left[: max(n - reach, 0)] > reach)
        after[on] = rank[on + reach]
        both = rank * (int(rank.max(initial=0)) + 1) + after
        order = np.argsort(both, kind="stable")
        inner = both[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(True, inner[1:] != inner[:-1])[:n])
        ranks.append(rank)
        reach *= 2
    if order is None:
        order = np.argsort(ranks[0], kind="stable")
    common = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        got = np.zeros(n - 1, np.int64)
        room = np.minimum(np.minimum(left[a], left[b]), depth)
        for k in range(len(ranks) - 1, -1, -1):
            step = 1 << k
            at = np.flatnonzero(got + step <= room)
            x, y = a[at] + got[at], b[at] + got[at]
            got[at[ranks[k][x] == ranks[k][y]]] += step
        common[1:] = got
    return order, common


def ngrams(keys: np.ndarray, left: np.ndarray, shortest: int, longest: int):
    """(n, places, counts): for each length the distinct n-grams of the runs, by a place of each."""
    begins = np.flatnonzero(left >= shortest)
    if not len(begins):
        return
    inside = np.zeros(len(keys) + 1, bool)
    for k in range(shortest):  # words of runs that are too short are left out of the sort
        inside[begins + k] = True
    kept = np.flatnonzero(inside[:-1])
    left = np.minimum(left[kept], longest)
    _, ids = np.unique(keys[kept], return_inverse=True)
    order, common = suffix_array(ids, left, longest)
    for n in range(shortest, longest + 1):
        long = left[order] >= n
        heads = np.cumsum(common < n)[long]  # a new interval wherever fewer than n words are shared
        if not len(heads):
            continue
        at = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
        yield n, kept[order[long][at]], np.diff(np.append(at, len(heads)))


def _runs_left(links: np.ndarray) -> np.ndarray:
    """Words from each place to its run's end; ``links``: whether a place is tied to the next."""
    n = len(links)
    ends = np.flatnonzero(~links)
    return ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1 if n else np.zeros(0, np.int64)


def _counted_words(docs: DataFrame) -> DataFrame:
    """(lang, word, w, n): words by language, summed in the task as far as they fit."""

    def run(batches):
        held: dict[str, Counter] = {}

        def out():
            for lang, counts in held.items():
                words = list(counts)
                for k in range(0, len(words), 1 << 16):
                    part = words[k : k + (1 << 16)]
                    columns = [[lang] * len(part), [w.decode("utf-8", "replace") for w in part], word_keys(part, lang).view(np.int64), [counts[w] for w in part]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["lang", "word", "w", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text:
                    held.setdefault(lang, Counter()).update(text.translate(_PLAIN).split(b" "))
            for counts in held.values():
                counts.pop(b"", None)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from out()
        yield from out()

    return map_arrow(docs, run, "lang string, word string, w long, n long")


def _in_shards(docs: DataFrame, words, pairs, shortest: int, longest: int, start, schema: str) -> DataFrame:
    """What a task's sink, made by ``start``, gives for the n-grams of its shards, over words and pairs whose bits are set."""

    def run(batches):
        frequent = np.frombuffer(words.value, np.uint8)
        tied = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        sink = start()

        def tied_places(keys, heads):
            links = np.zeros(len(keys), bool)
            good = _has(frequent, keys)
            links[:-1] = ~heads[1:] & good[:-1] & good[1:]
            if tied is not None:
                at = np.flatnonzero(links)
                links[at] = _has(tied, _pair_keys(keys[at], keys[at + 1]))
            return _runs_left(links)

        def out(keys, heads):
            for n, places, counts in ngrams(keys, tied_places(keys, heads), shortest, longest):
                yield from sink.add(keys, n, places, counts)

        def over_border(keys, heads, border):
            """N-grams that begin before ``border`` and end after it."""
            left = tied_places(keys, heads)
            for n in range(shortest, longest + 1):
                at = [i for i in range(max(0, border - n + 1), border) if left[i] >= n]
                if at:
                    yield from sink.add(keys, n, np.array(at), np.ones(len(at), np.int64))

        def flush():
            keys, heads = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            for lo in range(0, len(keys), SHARD):
                hi = lo + SHARD
                yield from out(keys[lo:hi], heads[lo:hi])
                if hi < len(keys):
                    lo = hi - longest + 1
                    yield from over_border(keys[lo : hi + longest - 1], heads[lo : hi + longest - 1], longest - 1)

        n = 0
        for batch in batches:
            langs = [_language(x) for x in batch.column(0).to_pylist()]
            for lo, hi in row_slices(batch.column(1), _WINDOW):
                held.append(_tokens(*vt.buffers(batch.column(1).slice(lo, hi - lo)), langs[lo:hi]))
                n += len(held[-1][0])
                if n >= SHARD:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()
        yield from sink.close()

    return map_arrow(docs, run, schema)


class _Pairs:
    """A task's pairs of words: sorted keys and counts up to ``least``, a row for each range of keys."""

    SCHEMA = "range int, keys binary, counts binary"

    def __init__(self, ranges: int, least: int) -> None:
        self.ranges, self.least = ranges, least
        self.found = vt.Counter(1)

    def add(self, keys, n, places, counts):
        self.found.add(_pair_keys(keys[places], keys[places + 1]), [counts])
        if len(self.found) > HELD_KEYS:
            yield from self.close()

    def close(self):
        k, (c,) = self.found.take()
        cuts = np.searchsorted(_range_of(k, self.ranges), np.arange(self.ranges + 1, dtype=np.uint64)).tolist()
        parts = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]
        if parts:
            rows = [[i for i, _, _ in parts], [packed_keys(k[a:b]) for _, a, b in parts], [packed(np.minimum(c[a:b], self.least)) for _, a, b in parts]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "keys", "counts"])


class _Phrases:
    """A task's n-grams as words' keys, and their counts: a row for each length and range of hashes."""

    SCHEMA = "range int, size int, words binary, counts binary"

    def __init__(self, ranges: int) -> None:
        self.ranges = ranges
        self.held = _Summed()

    def add(self, keys, n, places, counts):
        self.held.add(np.stack([keys[places + i] for i in range(n)]), counts)
        if self.held.rows > HELD_KEYS:
            yield from self.close()

    def close(self):
        rows = []
        for n, ws, c in self.held.take():
            h = ws[0]
            for w in ws[1:]:
                h = vt.mix(h * np.uint64(3) + w)
            at = (h >> np.uint64(32)) * np.uint64(self.ranges) >> np.uint64(32)
            order = np.argsort(at, kind="stable")
            cuts = np.searchsorted(at[order], np.arange(self.ranges + 1, dtype=np.uint64)).tolist()
            rows += [(i, n, ws[:, order[lo:hi]].tobytes(), packed(c[order[lo:hi]])) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "size", "words", "counts"])


class _Summed:
    """Counts by n-gram, for each length: columns of words' keys, summed now and then."""

    def __init__(self) -> None:
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.rows, self.most = 0, 1 << 20

    def add(self, ws: np.ndarray, counts: np.ndarray) -> None:
        self.parts.setdefault(len(ws), []).append((ws, counts))
        self.rows += len(counts)
        if self.rows > self.most:
            kept = list(self.take())
            for _, w, c in kept:
                self.parts[len(w)] = [(w, c)]
                self.rows += len(c)
            self.most = max(1 << 20, 2 * self.rows)

    def take(self):
        """(n, words, counts) of each length; afterwards nothing is held."""
        for n, parts in sorted(self.parts.items()):
            ws, c = np.concatenate([w for w, _ in parts], axis=1), np.concatenate([c for _, c in parts])
            order = np.lexsort(ws[::-1])
            ws = ws[:, order]
            heads = np.flatnonzero(np.append(True, (ws[:, 1:] != ws[:, :-1]).any(axis=0)))[: len(c)]
            yield n, ws[:, heads], np.add.reduceat(c[order], heads) if len(c) else c
        self.parts, self.rows = {}, 0


def _counted_phrases(docs: DataFrame, words, pairs, longest: int, least: int, ranges: int) -> DataFrame:
    """(ws, f): the n-grams of two words and more that occur ``least`` times."""

    def merged(batches):
        found = _Summed()
        for batch in batches:
            for n, data, counts in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                ws = np.frombuffer(data, np.uint64).reshape(n, -1)
                found.add(ws, unpacked(counts, ws.shape[1], 1)[0].astype(np.int64))
        for n, ws, c in found.take():
            ws, c = ws[:, c >= least], c[c >= least]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(ws.T).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([lists, pa.array(c)], names=["ws", "f"])

    sent = _in_shards(docs, words, pairs, 2, longest, lambda: _Phrases(ranges), _Phrases.SCHEMA)
    return map_arrow(sent.repartitionById(ranges, F.col("range")), merged, "ws array<long>, f long")


def _frequent_pairs(docs: DataFrame, words, least: int, ranges: int) -> DataFrame:
    """(k): keys of the pairs of words that occur ``least`` times, with others that share such a key."""

    def merged(batches):
        found = vt.Counter(1)
        for batch in batches:
            for keys, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                k = unpacked_keys(keys)
                found.add(k, [unpacked(counts, len(k), 1)[0]])
        k, (c,) = found.take()
        yield pa.RecordBatch.from_arrays([pa.array(k[c >= least].view(np.int64))], names=["k"])

    sent = _in_shards(docs, words, None, 2, 2, lambda: _Pairs(ranges, least), _Pairs.SCHEMA)
    return map_arrow(sent.repartitionById(ranges, F.col("range")), merged, "k long")


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return vt.mix(a * np.uint64(0x9E3779B97F4A7C15) + b) >> np.uint64(64 - PAIR_BITS)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys >> np.uint64(PAIR_BITS - 32)) * np.uint64(ranges) >> np.uint64(32)


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _bit_map(spark, keys) -> object:
    """A broadcast of 2**FILTER_BITS bits: those of the low bits of column ``k`` of ``keys``."""
    at = keys.select((F.col("k").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1).alias("at"))
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    size = 4096  # bytes of one of Spark's bit maps; bucket b has the values from 8 size (b - 1) + 1 on
    whole = bytearray(1 << FILTER_BITS - 3)
    for r in parts.collect():  # at most 2**FILTER_BITS / 32,768 rows
        whole[(r["bucket"] - 1) * size : r["bucket"] * size] = r["bits"]
    return spark.sparkContext.broadcast(bytes(whole))


def frequent_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (lang, n), words (lang, word, w, f) and phrases (ws, f), the last two of ``least`` occurrences or more."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    counted = written(_counted_words(texts).groupBy("lang", "word", "w").agg(F.sum("n").alias("f")), "words")
    totals = cut_lineage(counted.groupBy("lang").agg(F.sum("f").alias("n")))
    words = cut_lineage(counted.where(F.col("f") >= least))
    dropped(spark, counted)
    frequent = _bit_map(spark, words.select(F.col("w").alias("k")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tied = _bit_map(spark, _frequent_pairs(texts, frequent, least, ranges))
    phrases = cut_lineage(_counted_phrases(texts, frequent, tied, longest, least, ranges))
    return totals, words, phrases


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, scale: int = SCALE, report: int = REPORT
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``report`` phrases of 2 to ``longest`` words."""
    totals, words, phrases = frequent_phrases(docs, text_col, lang_col, least, longest)
    inner = phrases.where(F.size("ws") > 2).select(F.explode(F.array(F.expr("slice(ws, 1, size(ws) - 1)"), F.expr("slice(ws, 2, size(ws) - 1)"))).alias("part"), F.col("f").alias("whole"))
    covered = inner.groupBy("part").agg(F.max("whole").alias("whole"))
    # a phrase inside a longer one of the same count has one of a word more with that count, too
    open_ = phrases.join(covered, phrases.ws == covered.part, "left").where(F.col("whole").isNull() | (F.col("whole") < F.col("f"))).select("ws", F.col("f").alias("a"))
    cuts = open_.select("ws", "a", F.explode(F.sequence(F.lit(1), F.size("ws") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(ws, 1, k)"), "rest": F.expr("slice(ws, k + 1, size(ws) - k)")})
    known = words.select(F.array("w").alias("part"), "f").unionByName(phrases.select(F.col("ws").alias("part"), "f"))
    known = cut_lineage(known)
    if known.count() <= MAX_BROADCAST_IDS // 4:
        known = F.broadcast(known)
    left, right = known.select(F.col("part").alias("first"), F.col("f").alias("l")), known.select(F.col("part").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(left, "first").join(right, "rest")
    by_word = words.select(F.col("w").alias("head"), "lang")
    cuts = _looked_up(cuts.withColumn("head", F.col("ws")[0]), by_word, words, "head").join(F.broadcast(totals), "lang")  # a row a language
    score = F.expr(f"(cast({scale} as decimal(9,0)) * cast(a as decimal(14,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    least_cut = cuts.withColumn("score", score).groupBy("lang", "ws", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = least_cut.select("lang", "ws", "a", "n", "cut.score", "cut.l", "cut.r")
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("ws"), F.lit(SALTS)))
    high = W.partitionBy("lang", "salt").orderBy(F.desc("score"), F.desc("a"))
    near = cut_lineage(salted.withColumn("near", F.rank().over(high)).where(F.col("near") <= report).drop("near", "salt"))
    placed = near.select("lang", "ws", "a", "l", "r", "n", "score", F.posexplode("ws").alias("at", "w"))
    named = _looked_up(placed, words.select("w", "word"), words, "w")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")  # at most ``longest`` words
    texts = named.groupBy("lang", "ws", "a", "l", "r", "n", "score").agg(phrase.alias("phrase"))
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return texts.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= report).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _looked_up(rows: DataFrame, by_key: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """``rows`` and what ``by_key`` has for each: broadcast while small, else joined with a shuffle."""
    return rows.join(F.broadcast(by_key) if words.count() <= MAX_BROADCAST_IDS // 4 else by_key.hint("merge"), key)


ORACLE = rf"""WITH pieces AS (
    SELECT row_number() OVER () AS piece, lang, words FROM (
        SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(p, '[ \t]+'), lambda x: x <> '') AS words FROM (
            SELECT lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS p FROM documents))
    WHERE len(words) > 0),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS MATERIALIZED (
    SELECT lang, m, array_to_string(words[i : i + m - 1], ' ') AS phrase, count(*) AS f
    FROM pieces, range(1, {LONGEST + 1}) x(m), range(1, len(words) - m + 2) y(i) GROUP BY ALL HAVING count(*) >= {LEAST}),
phrases AS (SELECT *, string_split(phrase, ' ') AS ws FROM grams WHERE m > 1),
covered AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, max(f) AS f FROM phrases, range(2, m) x(k), range(1, m - k + 2) y(i) GROUP BY ALL),
cuts AS (
    SELECT p.lang, p.phrase, p.f AS a, k, l.f AS l, r.f AS r, t.n, ({SCALE}::HUGEINT * p.f * t.n) // (l.f::HUGEINT * r.f) AS score
    FROM phrases p CROSS JOIN range(1, p.m) x(k) JOIN totals t USING (lang)
    JOIN grams l ON l.lang = p.lang AND l.phrase = array_to_string(p.ws[1 : k], ' ') JOIN grams r ON r.lang = p.lang AND r.phrase = array_to_string(p.ws[k + 1 :], ' ')
    LEFT JOIN covered c ON c.lang = p.lang AND c.phrase = p.phrase WHERE c.f IS NULL OR c.f < p.f),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM lowest QUALIFY rank <= {REPORT}"""
