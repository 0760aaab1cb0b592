"""Benchmark decontamination: a BM25 index of test items, queried by every passage.

The index holds each test item as a BM25 document whose term scores are divided by the
item's own total, so a passage that holds all of an item scores 1.  Every document is
read in passages of twice the longest item (in tokens), half overlapping, so an item
that stands in a document stands whole in a passage.  Each passage is a query and all
items with a score of ``MIN_SCORE`` or more are retrieved, by block-max WAND (Ding and
Suel 2011); then the words decide: the item's word 5-shingles must be in the passage to
``MIN_CONTAINMENT``, and the words of its question and of its answer to ``MIN_PART``.

Most passages cannot reach the threshold.  For each item the terms with the smallest
scores are set aside while their sum stays under a share of the threshold; a passage that has none
of the other, essential, terms of an item cannot retrieve it, and one that has too few
of them neither.  These bounds are computed for a slice of texts at once, and only
passages that pass them are handed to WAND, which is exact.

The benchmark is read in shards of at most ``SHARD_ITEMS`` items, by a hash of the item
id; each shard's index is broadcast on its own, so a broadcast's size is bounded however
large the benchmark is.  Document frequencies, the mean length and the passages' length
are those of the whole benchmark, so shards don't change a score or a match.

Defined results: null or empty texts and items match nothing; an item with fewer than
five words is one shingle of all its words; repeated rows give repeated results; an empty
benchmark matches nothing.  An item with no explicit answer column is split at its last
line or else its last sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm import vectext as vt
from eventloom.llm.common import cut_lineage, map_arrow, row_slices

K1, B = 1.2, 0.75
MIN_SCORE = 0.6
MIN_CONTAINMENT = 0.8
MIN_PART = 0.8
SHINGLE = 5
BLOCK = 64
SHARD_ITEMS = 20_000
#: Share of the threshold that an item's terms set aside may sum to, under 1: a smaller
#: share means more essential postings and fewer passages that reach the threshold by bound.
ASIDE = 0.3
#: Bits of the table that tells words outside the index from those that may be in it.
FILTER_BITS = 20


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item: split at the last line, or else the last sentence."""
    text = text.strip()
    cut = text.rfind("\n")
    if cut < 0:
        stops = [m.end() for m in re.finditer(r"[.!?]\s", text)]
        cut = stops[-1] if stops else text.rfind(" ", 0, len(text) * 3 // 4 + 1) + 1
    return text[:cut], text[cut:]


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words (letters and digits, lower-cased), and offsets by text."""
    starts, ends, kind = vt.runs(vt.CLASSES[buf], off)
    word = kind == vt.WORD
    starts, ends = starts[word], ends[word]
    return vt.hashes(buf, starts, ends, lower=True), vt.per_text(starts, off)


def _of(texts: list[str]) -> list[np.ndarray]:
    import pyarrow as pa

    h, first = tokens(*vt.buffers(pa.array(texts, pa.string())))
    return [h[a:b] for a, b in zip(first, first[1:], strict=False)]


class Statistics:
    """Number of items with words, their mean and greatest length, and how many items each term is in."""

    def __init__(self, items: int, mean: float, longest: int, terms: np.ndarray, df: np.ndarray) -> None:
        self.items, self.mean, self.longest, self.terms, self.df = items, mean, longest, terms, df

    @staticmethod
    def of(words: list[np.ndarray]) -> Statistics:
        sizes = [len(w) for w in words]
        terms, df = np.unique(np.concatenate([*(np.unique(w) for w in words), np.zeros(0, np.uint64)]), return_counts=True)
        return Statistics(len(words), float(np.mean(sizes)) if sizes else 0.0, max(sizes, default=1), terms, df)

    def frequencies(self, terms: np.ndarray) -> np.ndarray:
        return self.df[np.searchsorted(self.terms, terms)]


class Index:
    """Postings of normalised BM25 scores by term, with block maxima and essential parts."""

    def __init__(self, items: list[tuple[object, str, str]], min_score: float = MIN_SCORE, whole_set: Statistics | None = None) -> None:
        """``items``: (id, question, answer), all of the benchmark or a shard of what ``whole_set`` describes."""
        questions, answers = _of([q for _, q, _ in items]), _of([a for _, _, a in items])
        whole = [np.concatenate(x) for x in zip(questions, answers, strict=True)]
        some = [i for i, w in enumerate(whole) if len(w)]
        self.ids = [items[i][0] for i in some]
        self.questions, self.answers = [np.unique(questions[i]) for i in some], [np.unique(answers[i]) for i in some]
        words = [whole[i] for i in some]
        self.min_score = min_score
        whole_set = whole_set or Statistics.of(words)
        self.longest = whole_set.longest
        self.shingle = [min(SHINGLE, len(w)) for w in words]
        self.shingles = [np.unique(vt.grams(w, np.array([0, len(w)]), n)[0]) for w, n in zip(words, self.shingle, strict=True)]
        self._postings(words, whole_set)
        self._essential()

    def _postings(self, words: list[np.ndarray], whole_set: Statistics) -> None:
        item = np.repeat(np.arange(len(words)), [len(w) for w in words])
        flat = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.terms, term = np.unique(flat, return_inverse=True)
        n = max(len(words), 1)
        pair, tf = np.unique(term * n + item, return_counts=True)
        term, item = pair // n, pair % n
        df = whole_set.frequencies(self.terms)
        length = np.bincount(item, tf, n)
        idf = np.log(1 + (whole_set.items - df + 0.5) / (df + 0.5))
        score = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / max(whole_set.mean, 1e-9)))
        score /= np.bincount(item, score, n)[item]
        self.offsets = np.searchsorted(term, np.arange(len(self.terms) + 1))
        self.term, self.item, self.score = term, item, score
        self.top = np.maximum.reduceat(score, self.offsets[:-1]) if len(score) else score
        self.lists = [item[a:b].tolist() for a, b in zip(self.offsets, self.offsets[1:], strict=False)]
        self.maxima = [[float(score[k : min(k + BLOCK, b)].max()) for k in range(a, b, BLOCK)] for a, b in zip(self.offsets, self.offsets[1:], strict=False)]

    def _essential(self) -> None:
        """Set each item's smallest terms aside while their sum stays under a share of the threshold."""
        order = np.lexsort((self.score, self.item))
        item, score = self.item[order], self.score[order]
        total = np.concatenate([[0.0], np.cumsum(score)])
        heads = np.searchsorted(item, np.arange(len(self.ids) + 1))
        within = total[1:] - total[heads[item]]
        aside = within < ASIDE * self.min_score
        self.rest = np.bincount(item[aside], score[aside], max(len(self.ids), 1))
        keep = np.sort(order[~aside])
        self.essential_item, self.essential_score = self.item[keep], self.score[keep]
        self.essential_offsets = np.searchsorted(self.term[keep], np.arange(len(self.terms) + 1))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.terms >> np.uint64(64 - FILTER_BITS)] = True

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` of words that are terms, and the terms."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(64 - FILTER_BITS)])
        if not len(at):
            return at, at
        term = np.minimum(np.searchsorted(self.terms, h[at]), len(self.terms) - 1)
        known = self.terms[term] == h[at]
        return at[known], term[known]

    def candidates(self, at: np.ndarray, term: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Passages (text * 2**32 + number) that the essential terms leave in the race."""
        counts = (self.essential_offsets[term + 1] - self.essential_offsets[term]).astype(np.int64)
        hit = np.flatnonzero(counts)
        if not len(hit):
            return np.zeros(0, np.int64)
        counts, at, term = counts[hit], at[hit], term[hit]
        text = np.searchsorted(first, at, "right") - 1
        number = (at - first[text]) // self.longest
        owner = np.repeat(np.arange(len(hit)), counts)
        posting = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + self.essential_offsets[term[owner]]
        passage = np.concatenate([(text << 32 | number)[owner], (text << 32 | (number - 1))[owner][(number > 0)[owner]]])
        posting = np.concatenate([posting, posting[(number > 0)[owner]]])
        passages, p = np.unique(passage, return_inverse=True)
        n = len(self.essential_item)
        pairs = np.unique(p * n + posting)  # a term counts once in a passage
        p, posting = pairs // n, pairs % n
        of = p * len(self.ids) + self.essential_item[posting]
        keys, k = np.unique(of, return_inverse=True)
        reach = np.bincount(k, self.essential_score[posting]) + self.rest[keys % len(self.ids)]
        return passages[np.unique(keys[reach >= self.min_score - 1e-9] // len(self.ids))]

    def retrieve(self, terms: list[int]) -> list[tuple[int, float]]:
        """All (item, score) with at least the least score for a query of distinct terms: block-max WAND."""
        least = self.min_score - 1e-9
        cursor = {t: 0 for t in terms}
        out = []
        while cursor:
            order = sorted(cursor, key=lambda t: self.lists[t][cursor[t]])
            bound, pivot = 0.0, -1
            for k, t in enumerate(order):
                bound += float(self.top[t])
                if bound >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            goal = self.lists[order[pivot]][cursor[order[pivot]]]
            while pivot + 1 < len(order) and self.lists[order[pivot + 1]][cursor[order[pivot + 1]]] == goal:
                pivot += 1
            front = order[: pivot + 1]
            blocks = {t: bisect_left(self.lists[t], goal, cursor[t]) // BLOCK for t in front}
            if sum(self.maxima[t][b] for t, b in blocks.items() if b < len(self.maxima[t])) < least:
                ends = [self.lists[t][min((b + 1) * BLOCK, len(self.lists[t])) - 1] for t, b in blocks.items() if b < len(self.maxima[t])]
                after = [self.lists[t][cursor[t]] for t in order[pivot + 1 : pivot + 2]]
                goal = max(goal, min([e + 1 for e in ends] + after))
            elif self.lists[order[0]][cursor[order[0]]] == goal:
                score = sum(float(self.score[self.offsets[t] + cursor[t]]) for t in front)
                if score >= least:
                    out.append((goal, score))
                goal += 1
            for t in front:
                cursor[t] = bisect_left(self.lists[t], goal, cursor[t])
                if cursor[t] >= len(self.lists[t]):
                    del cursor[t]
        return out

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float, float]:
        """Shares of the item's shingles, question words and answer words that are in ``words``."""
        n = self.shingle[item]
        own = vt.grams(words, np.array([0, len(words)]), n)[0]
        share = lambda a, b: float(np.isin(a, b).mean()) if len(a) else 1.0
        return share(self.shingles[item], own), share(self.questions[item], words), share(self.answers[item], words)

    def matches(self, buf: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, float, float, float]]:
        """(text, item, score, containment, question share, answer share), the best of each text and item."""
        if not self.ids:
            return []
        h, first = tokens(buf, off)
        at, term = self.lookup(h)
        best: dict[tuple[int, int], tuple] = {}
        for passage in self.candidates(at, term, first).tolist():
            text, number = passage >> 32, passage & 0xFFFFFFFF
            lo = int(first[text]) + number * self.longest
            hi = min(lo + 2 * self.longest, int(first[text + 1]))
            a, b = np.searchsorted(at, (lo, hi))
            for item, score in self.retrieve(np.unique(term[a:b]).tolist()):
                shares = self.verify(item, h[lo:hi])
                if shares[0] >= MIN_CONTAINMENT and min(shares[1:]) >= MIN_PART and score > best.get((text, item), (0.0,))[0]:
                    best[text, item] = (score, *shares)
        return [(*k, *v) for k, v in sorted(best.items())]


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, shard_items: int = SHARD_ITEMS):
    """The indexes of the benchmark's shards, one at a time."""
    answer = items[answer_col].cast("string") if answer_col else F.lit(None).cast("string")
    plain = items.select(items[id_col].alias("id"), items[text_col].cast("string").alias("text"), answer.alias("answer")).where("text is not null")
    n = plain.count()
    if n <= shard_items:
        yield Index(_items(plain.collect()))
        return
    shards = -(-2 * n // shard_items)
    numbered = cut_lineage(plain.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards))))

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            found = [np.concatenate(_of([*(parts(t) if a is None else (t, a))])) for t, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(np.unique(w)) for w in found])]), pa.int32())
            terms = np.concatenate([*(np.unique(w) for w in found), np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([len(w) for w in found], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms))], names=["shard", "size", "terms"])

    sized = cut_lineage(map_arrow(numbered.select("text", "answer", "shard"), words, "shard long, size long, terms array<long>"))
    total = sized.where("size > 0").agg(F.count("*"), F.avg("size"), F.max("size")).first()
    terms = sized.select("shard", F.explode("terms").alias("term"))
    df = cut_lineage(terms.groupBy("term").agg(F.count("*").alias("df")))
    for k in range(shards):
        own = terms.where(F.col("shard") == k).select("term").distinct().join(df, "term").toArrow()  # the terms of one shard
        t, f = own["term"].to_numpy().astype(np.int64).view(np.uint64), own["df"].to_numpy()
        order = np.argsort(t)
        rows = numbered.where(F.col("shard") == k).collect()  # about half of shard_items
        yield Index(_items(rows), whole_set=Statistics(total[0], total[1] or 0.0, total[2] or 1, t[order], f[order]))


def _items(rows) -> list[tuple[object, str, str]]:
    """(id, question, answer) of rows (id, text, answer), in the order of ids and texts."""
    made = [(r["id"], *(parts(r["text"]) if r["answer"] is None else (r["text"], r["answer"]))) for r in rows]
    return sorted(made, key=lambda x: (x[0] is not None, x[0] or 0, x[1:]))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(id_col, item_col, score, containment, question_overlap, answer_overlap): a row for each match."""
    doc, item = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"id {doc}, item {item}, score double, containment double, question_overlap double, answer_overlap double"
    found = None
    for index in indexes(items, item_col, item_text, answer_col, shard_items):
        part = map_arrow(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")), _matcher(docs.sparkSession.sparkContext.broadcast(index)), schema)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("id", id_col).withColumnRenamed("item", item_col)


def _matcher(shared):
    def run(batches):
        import pyarrow as pa

        index = shared.value
        names = ["id", "item", "score", "containment", "question_overlap", "answer_overlap"]
        for batch in batches:
            for a, b in row_slices(batch.column(1), vt.SLICE):
                found = index.matches(*vt.buffers(batch.column(1).slice(a, b - a)))
                if found:
                    text, item, *shares = zip(*found, strict=True)
                    ids = batch.column(0).slice(a, b - a).take(pa.array(text))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([index.ids[i] for i in item]), *(pa.array(s) for s in shares)], names=names)

    return run


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", answer_col: str | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``docs`` without the documents that hold a test item; all columns stay as they are."""
    for index in indexes(items, item_col, item_text, answer_col, shard_items):
        docs = map_arrow(docs, _filter(docs.sparkSession.sparkContext.broadcast(index), docs.columns.index(text_col)), docs.schema)
    return docs


def _filter(shared, column: int):
    def run(batches):
        import pyarrow as pa

        index = shared.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, b in row_slices(batch.column(column), vt.SLICE):
                for found in index.matches(*vt.buffers(batch.column(column).slice(a, b - a))):
                    keep[a + found[0]] = False
            yield batch if keep.all() else batch.filter(pa.array(keep))

    return run
