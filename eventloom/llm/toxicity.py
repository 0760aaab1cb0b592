"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs that skip one word of a text,
hashed into ``2**BITS`` coordinates.  FTRL-proximal keeps a learning rate for each
coordinate, and its L1 term leaves most weights at exactly zero, so what is broadcast
for scoring is a short list of (coordinate, weight).

The classifier is fitted on a bounded, hash-chosen sample of the labelled documents
(``MAX_POSITIVE`` and ``MAX_NEGATIVE``): Spark hashes their features in parallel and one
task, whose input is bounded by those two numbers, runs the online updates.  Scoring is
one narrow pass over every document.

Defined results: a null or empty text has only the bias; a label that is null is not
used; of several labels for one id the greatest counts, and of several texts the last in
order, so the sample's bound holds for rows as well; without any usable label all
scores are 0.5 at a weight of zero and predicted is 1 by the stated rule.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import vectext as vt
from eventloom.llm.common import bounded_sample, map_arrow, map_texts

BITS = 20
MAX_POSITIVE, MAX_NEGATIVE = 4_000, 8_000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 3.0, 0.1, 6


def features(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates of the texts' words, pairs and skip-pairs, with each one's text number."""
    starts, ends, kind = vt.runs(vt.CLASSES[buf], off)
    words = kind == vt.WORD
    starts, ends = starts[words], ends[words]
    h = vt.hashes(buf, starts, ends, lower=True)
    first = vt.per_text(starts, off)
    pairs, pair_first = vt.grams(h, first, 2)
    owner = vt.owners(first)
    skip_at = np.flatnonzero(owner[:-2] == owner[2:]) if len(owner) > 2 else np.zeros(0, np.int64)
    skips = vt.mix(h[skip_at] * np.uint64(3) + h[skip_at + 2] * np.uint64(5))
    at = (np.concatenate([vt.mix(h), pairs, skips]) >> np.uint64(64 - bits)).astype(np.int64)
    return at, np.concatenate([owner, vt.owners(pair_first), owner[skip_at]])


class Ftrl:
    """Per-coordinate FTRL-proximal (McMahan et al. 2013) with binary features and a free bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias_z = self.bias_n = 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2), 0.0)

    def bias(self) -> float:
        return -self.bias_z / ((self.beta + self.bias_n**0.5) / self.alpha)

    def update(self, at: np.ndarray, label: float) -> None:
        w, b = self.weights(at), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g
        self.bias_z += g - ((self.bias_n + g * g) ** 0.5 - self.bias_n**0.5) / self.alpha * b
        self.bias_n += g * g


def train(examples: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Nonzero coordinates, their weights and the bias from ``examples`` (id, text, label).

    ``examples`` must be bounded: one task learns from all of them, in the order of ids.
    """

    def start():
        def make(buf, off):
            import pyarrow as pa

            at, owner = features(buf, off, bits)
            keys = np.unique(owner << bits | at)
            counts = np.bincount(keys >> bits, minlength=len(off) - 1)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
            return [pa.ListArray.from_arrays(offsets, pa.array(keys & ((1 << bits) - 1), pa.int32()))]

        return make

    def learn(batches):
        import pyarrow as pa

        rows = []
        for b in batches:
            values, offsets = b.column(2).values.to_numpy(), b.column(2).offsets.to_numpy()
            rows += [(i, y, values[lo:hi]) for i, y, lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), offsets, offsets[1:], strict=False)]
        rows.sort(key=lambda r: (hash(r[0]) * 0x9E3779B1 % 2**32, r[0]))
        model = Ftrl(1 << bits)
        for _ in range(EPOCHS):
            for _, label, at in rows:
                model.update(at, float(label))
        w = model.weights(slice(None))
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(w[some], model.bias()))], names=["at", "weight"])

    featured = map_texts(examples, "text", ["id", "label"], [T.StructField("features", T.ArrayType(T.IntegerType()))], start)
    found = map_arrow(featured.repartition(1), learn, "at long, weight double").toPandas()
    some = found[found["at"] >= 0].sort_values("at")
    return some["at"].to_numpy(np.int64), some["weight"].to_numpy(np.float64), float(found.loc[found["at"] < 0, "weight"].sum())


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights learnt from a bounded sample of the documents that ``labels`` marks 0 or 1."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).cast("long").alias("label"))
    sample = bounded_sample(marked.where("label = 1"), "label_id", MAX_POSITIVE).unionByName(bounded_sample(marked.where("label = 0"), "label_id", MAX_NEGATIVE))
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = plain.join(F.broadcast(sample), plain.id == sample.label_id).select(plain.id.cast("long").alias("id"), "text", "label")
    return train(rows.groupBy("id", "label").agg(F.max("text").alias("text")).select("id", "text", "label"), bits)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(id_col, score, predicted) for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        some, values, bias = shared.value
        weights = np.zeros(1 << bits)
        weights[some] = values

        def make(buf, off):
            at, owner = features(buf, off, bits)
            used = weights[at] != 0
            keys = np.unique(owner[used] << bits | at[used])
            total = np.bincount(keys >> bits, weights[keys & ((1 << bits) - 1)], len(off) - 1) + bias
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            return [p, (p >= 0.5).astype(np.int32)]

        return make

    return map_texts(docs, text_col, [id_col], [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], start)
