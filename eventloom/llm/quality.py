"""Quality rules: base text rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word n-grams, one of trusted documents and one of the
raw corpus, give each n-gram a log ratio; a document's score is the mean ratio of its
n-grams, so its length does not matter.  A document is kept if the base rules pass and
its score reaches a fixed threshold.

Both multinomials are counted by map-side sums over the whole corpus: a task sends at
most ``2**bits`` rows whatever it has read, and the model that goes back to the tasks
is one array of ``2**bits`` numbers.  All trusted documents count; a long list of their
ids is joined with a shuffle.

Tokens: runs of letters and digits (lower-cased; words written in capitals become one
token of their own) and runs of other marks.  N-grams: single tokens and pairs.

Defined results: a null or empty text has no words, fails the base rules and scores 0;
repeated rows give repeated results; without trusted documents every score is 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import vectext as vt
from eventloom.llm.common import flagged, map_arrow, map_texts

#: Buckets of n-grams are 2**BITS.
BITS = 16
#: Scores under this are not kept.
THRESHOLD = -0.35
MIN_WORDS = 10
MAX_REPEAT_SHARE = 20

_CAPITALS = np.uint64(0xC0FFEE123456789B)
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_IS_NEWLINE = np.zeros(256, bool)
_IS_NEWLINE[10] = True


def base_counts(buf: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    space = vt.IS_SPACE[buf]
    starts, ends = vt.segments(space, off)
    first = vt.per_text(starts, off)
    lo, hi = off[:-1], off[1:]
    chars = vt.range_sums(~space & ((buf & 0xC0) != 0x80), lo, hi)
    symbols = vt.range_sums(_IS_SYMBOL[buf], lo, hi)
    return [np.diff(first), chars, symbols, _dup_lines(buf, off, starts), _repeated_words(vt.hashes(buf, starts, ends, lower=False), first)]


def _dup_lines(buf: np.ndarray, off: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    starts, ends = vt.segments(_IS_NEWLINE[buf], off)
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[worded], ends[worded]
    text = np.searchsorted(off, starts, "right") - 1
    keys = vt.mix(vt.hashes(buf, starts, ends, lower=False) + vt.mix(text.astype(np.uint64)))
    _, heads = np.unique(keys, return_index=True)
    n = len(off) - 1
    return np.bincount(text, minlength=n) - np.bincount(text[heads], minlength=n)


def _repeated_words(words: np.ndarray, first: np.ndarray, size: int = 5) -> np.ndarray:
    windows, offsets = vt.grams(words, first, size)
    owner = vt.owners(offsets)
    keys = vt.mix(windows + vt.mix(owner.astype(np.uint64)))
    in_order = np.sort(keys)
    twice = in_order[1:][in_order[1:] == in_order[:-1]]
    if not len(twice):
        return np.zeros(len(first) - 1, np.int64)
    again = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys)
    at = again - offsets[owner[again]] + first[owner[again]]
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return vt.range_sums(np.cumsum(step[:-1]) > 0, first[:-1], first[1:])


def ngrams(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' n-grams, and n + 1 offsets by text."""
    starts, ends, kind = vt.runs(vt.CLASSES[buf], off)
    h = vt.hashes(buf, starts, ends, lower=True)
    big = vt.range_sums(vt.IS_UPPER[buf], starts, ends)
    small = vt.range_sums(vt.IS_LOWER[buf], starts, ends)
    h[(kind == vt.WORD) & (big >= 2) & (small == 0)] = _CAPITALS
    first = vt.per_text(starts, off)
    pairs, pair_first = vt.grams(h, first, 2)
    shift = np.uint64(64 - bits)
    counts = np.diff(first) + np.diff(pair_first)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(offsets[-1], np.int64)
    owner, pair_owner = vt.owners(first), vt.owners(pair_first)
    out[np.arange(len(h)) - first[owner] + offsets[owner]] = vt.mix(h) >> shift
    out[np.arange(len(pairs)) - pair_first[pair_owner] + offsets[pair_owner] + np.diff(first)[pair_owner]] = pairs >> shift
    return out, offsets


def count_ngrams(docs: DataFrame, text: str, trusted: str, bits: int = BITS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all ``docs`` and over those with ``trusted`` true."""

    def run(batches):
        import pyarrow as pa

        from eventloom.llm.common import row_slices

        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            column, flags = batch.column(0), np.array(batch.column(1).fill_null(False))
            for a, b in row_slices(column, vt.SLICE):
                buckets, offsets = ngrams(*vt.buffers(column.slice(a, b - a)), bits)
                raw += np.bincount(buckets, minlength=1 << bits)
                target += np.bincount(buckets[np.repeat(flags[a:b], np.diff(offsets))], minlength=1 << bits)
        some = np.flatnonzero(raw)
        for k in range(0, len(some), 10_000):
            at = some[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counts = map_arrow(docs.select(docs[text].cast("string"), docs[trusted].cast("boolean")), run, "bucket long, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame, bits: int = BITS) -> np.ndarray:
    """Log of target over raw probability by bucket; additive smoothing of one a bucket."""
    raw, target = np.zeros(1 << bits), np.zeros(1 << bits)
    for r in counts.toLocalIterator():  # 2**bits rows at most
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.sum():
        return np.zeros(1 << bits, np.float32)
    p, q = (target + 1) / (target.sum() + len(target)), (raw + 1) / (raw.sum() + len(raw))
    return np.log(p / q).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = BITS) -> np.ndarray:
    """The log ratios of ``docs``, of which those that ``labels`` marks 1 are trusted."""
    marked = flagged(docs.select(docs[id_col].alias("id_"), docs[text_col].alias("text_")), "id_", labels.where(F.col(label_col) == 1).select(id_col), "trusted_")
    return log_ratios(count_ngrams(marked, "text_", "trusted_", bits), bits)


FIELDS = [
    *(T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
]


def judge(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row a document: the base counts, the score and the verdict."""
    bits = int(len(ratios)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def start():
        weights = shared.value

        def make(buf, off):
            counts = base_counts(buf, off)
            buckets, offsets = ngrams(buf, off, bits)
            n = np.diff(offsets)
            score = vt.range_sums(weights[buckets].astype(np.float64), offsets[:-1], offsets[1:]) / np.maximum(n, 1)
            failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_SHARE * counts[0])
            return [*counts, failed, ~failed & (score >= threshold), score]

        return make

    return map_texts(docs, text_col, [id_col], FIELDS, start)
