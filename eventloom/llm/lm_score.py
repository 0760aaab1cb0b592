"""Language-model scoring: cross-entropy difference of two matched bigram models.

A target model (trusted documents) and a background model (all documents) have the same
order, the same smoothing and one shared vocabulary: every word of the corpus.  A
document's score is the mean over its tokens of target loss minus background loss: the
lower, the more the document is like the target.  With n for a model's counts, c for its
counts of a word as context, N for its tokens and p0 for the share of a word in the corpus:

    p1(w)     = (n(w) + WORD_PRIOR * p0(w)) / (N + WORD_PRIOR)
    p(w | v)  = (n(v, w) + PAIR_PRIOR * p1(w)) / (c(v) + PAIR_PRIOR)

Both sum to one over the vocabulary.  No word and no pair is left out of a model, however
large the corpus: counts never meet in one place.  The documents are dealt into shards by
a hash.  A shard counts its own distinct words and pairs and sends them, sorted, to the
buckets of a split key space; a bucket adds up what all shards have sent it and answers
each with what the others have more, in the order the keys came; with the answers, and
nothing else, the shard's documents are scored.  Thus a word that every document has costs
one number a shard, and a task holds one shard or one bucket, whose sizes are parameters.

Defined results: a null or empty text, or one without words, has no tokens and null
losses; repeated rows count as often as they occur and give repeated results; without
target documents both models are the background's and all scores are zero.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import vectext as vt
from eventloom.llm.common import flagged, map_texts
from eventloom.plans.shipping import ship

WORD_PRIOR, PAIR_PRIOR = 10_000.0, 4.0
#: Bytes of text in a shard: the root of all bytes times SHARD_ROOT, within these bounds.
#: Messages between shards and buckets grow with the square of the number of shards.
SHARD_ROOT, LEAST_SHARD, MOST_SHARD = 100, 8 << 20, 192 << 20

#: The context of a text's first word.
_START = np.uint64(0x5851F42D4C957F2D)


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' words (letters and digits, lower-cased), and offsets by text."""
    starts, ends, kind = vt.runs(vt.CLASSES[buf], off)
    word = kind == vt.WORD
    starts, ends = starts[word], ends[word]
    return vt.hashes(buf, starts, ends, lower=True), vt.per_text(starts, off)


class Shard:
    """The words of a shard's documents, and the distinct words and pairs among them."""

    def __init__(self, column) -> None:
        from eventloom.llm.common import row_slices

        words, counts = [], []
        for chunk in column.chunks:
            for a, b in row_slices(chunk, vt.SLICE):
                h, first = _words(*vt.buffers(chunk.slice(a, b - a)))
                words.append(h)
                counts.append(np.diff(first))
        words = np.concatenate([*words, np.zeros(0, np.uint64)])
        self.n = np.concatenate([*counts, np.zeros(0, np.int64)])
        heads = (np.cumsum(self.n) - self.n)[self.n > 0]
        self.vocabulary = np.unique(np.append(words, _START))
        #: places in the vocabulary of each word, and of the word before it.
        self.word = np.searchsorted(self.vocabulary, words).astype(np.int32)
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[heads] = np.searchsorted(self.vocabulary, _START)
        self.pair = vt.mix(self.vocabulary[self.context] * vt._BASE + vt.mix(words))
        self.pairs = np.unique(self.pair)

    def counts(self, target: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts of all tokens, or of those of the ``target`` documents: of words as such and as contexts, and of pairs."""
        some = slice(None) if target is None else np.repeat(target, self.n)
        words = np.stack([np.bincount(x[some], minlength=len(self.vocabulary)) for x in (self.word, self.context)])
        found, n = np.unique(self.pair[some], return_counts=True)
        pairs = np.zeros(len(self.pairs), np.int64)
        pairs[np.searchsorted(self.pairs, found)] = n
        return words, pairs


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from zero on, in as few bytes each as the greatest needs, byte by byte."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(data: bytes, n: int, columns: int) -> np.ndarray:
    """``columns`` rows of ``n`` numbers each, from their ``packed`` forms in a row."""
    whole, at, out = np.frombuffer(data, np.uint8), 0, []
    for _ in range(columns):
        width = int(whole[at])
        values = np.zeros((n, 8), np.uint8)
        values[:, :width] = whole[at + 1 : at + 1 + n * width].reshape(width, n).T
        out.append(values.view("<u8").ravel())
        at += 1 + n * width
    return np.stack(out)


def packed_keys(keys: np.ndarray) -> bytes:
    """Keys in order: the first one, and packed differences."""
    return keys[:1].tobytes() + packed(np.diff(keys)) if len(keys) else b""


def unpacked_keys(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    steps = unpacked(data[8:], (len(data) - 9) // data[8], 1)[0]
    return np.cumsum(np.concatenate([np.frombuffer(data, "<u8", 1), steps]), dtype=np.uint64)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of the key space starts in ``keys`` (sorted)."""
    of = (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(of, np.arange(buckets + 1, dtype=np.uint64))


_SENT = "shard long, bucket long, words binary, n_words binary, pairs binary, n_pairs binary"
#: Columns of counts by kind of key: background and target, for words as such and as contexts too.
_COLUMNS = {"words": 4, "pairs": 2}


def _counted(texts: DataFrame, buckets: int) -> DataFrame:
    """What the shards send: sorted keys and their counts, a row for each shard and bucket."""

    def count(table):
        import pyarrow as pa

        shard = Shard(table.column("text"))
        (w, p), (wt, pt) = shard.counts(), shard.counts(np.array(table.column("target").to_numpy(), bool))
        kinds = [(keys, np.concatenate(n), _cuts(keys, buckets).tolist()) for keys, n in ((shard.vocabulary, (w, wt)), (shard.pairs, ([p], [pt])))]
        rows = []
        for k in range(buckets):
            row = [k]
            for keys, n, at in kinds:
                part = slice(at[k], at[k + 1])
                row += [packed_keys(keys[part]), b"".join(packed(x[part]) for x in n)]
            rows.append(row)
        columns = list(zip(*rows, strict=True))
        number = table.column("shard")[0].as_py()
        return pa.table([pa.array([number] * buckets, pa.int64()), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["shard", "bucket", "words", "n_words", "pairs", "n_pairs"])

    return texts.groupBy("shard").applyInArrow(count, _SENT)


def _summed(sent: DataFrame) -> DataFrame:
    """The buckets' answers: for each row they got, what all other rows add to its counts, key by key."""

    def add(table):
        import pyarrow as pa

        answers = []
        for keys, columns in _COLUMNS.items():
            own = [unpacked_keys(x.as_py()) for x in table.column(keys)]
            counts = [unpacked(x.as_py(), len(k), columns) for x, k in zip(table.column(f"n_{keys}"), own, strict=True)]
            some = np.unique(np.concatenate(own))
            at = [np.searchsorted(some, k) for k in own]
            sums = np.zeros((columns, len(some)), np.uint64)
            for k, n in zip(at, counts, strict=True):
                sums[:, k] += n
            answers.append([b"".join(packed(x) for x in sums[:, k] - n) for k, n in zip(at, counts, strict=True)])
        return pa.table([table.column("shard"), table.column("bucket"), *(pa.array(a, pa.binary()) for a in answers)], names=["shard", "bucket", *_COLUMNS])

    return sent.groupBy("bucket").applyInArrow(add, "shard long, bucket long, words binary, pairs binary")


def losses(words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, tokens: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Loss of each token from one model's counts of its word, context and pair.

    ``tokens``: all tokens of the model; ``share``: the word's share in the corpus.
    """
    single = (words + WORD_PRIOR * share) / (tokens + WORD_PRIOR)
    return -np.log((pairs + PAIR_PRIOR * single) / (contexts + PAIR_PRIOR))


FIELDS = [T.StructField("n_tokens", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("ce_background", "ce_target", "score"))]


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int | None = None) -> DataFrame:
    """(id_col, n_tokens, ce_background, ce_target, score) in nats a token, for every row of ``docs``.

    The background is all of ``docs``, the target those whose ids are in ``targets`` (id_col).
    """
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    marked = flagged(plain, "id", targets.select(id_col), "target")

    def start():
        return lambda buf, off: [np.diff(_words(buf, off)[1])]

    sizes = map_texts(marked.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "text", ["target", "bytes"], [T.StructField("n", T.LongType())], start)
    n, m, size = sizes.agg(F.sum("n"), F.sum(F.when(F.col("target"), F.col("n"))), F.sum("bytes")).first()
    n, m, size = n or 0, m or 0, size or 0
    shard_bytes = shard_bytes or int(min(max(SHARD_ROOT * size**0.5, LEAST_SHARD), MOST_SHARD))
    shards = max(1, -(-size // shard_bytes))
    texts = marked.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards))).repartition(shards, "shard")
    answers = _summed(_counted(texts, shards).repartition(shards, "bucket")).repartition(shards, "shard")

    def judge(table, told):
        import pyarrow as pa

        shard = Shard(told.column("text"))
        (w, p), (wt, pt) = shard.counts(), shard.counts(np.array(told.column("target").to_numpy(), bool))
        table = table.sort_by("bucket")
        sums = []
        for name, keys, own in (("words", shard.vocabulary, np.concatenate([w, wt])), ("pairs", shard.pairs, np.stack([p, pt]))):
            at = np.diff(_cuts(keys, shards)).tolist()
            answers = table.column(name).to_pylist()
            if len(told) and len(answers) != shards:
                raise ValueError("a shard's documents have changed between counting and scoring")
            sums.append(own + np.concatenate([unpacked(x, k, len(own)).astype(np.int64) for x, k in zip(answers, at)], axis=1) if answers else own)
        words, pairs = sums
        total = np.zeros((2, len(shard.n)))
        ends, step = np.cumsum(shard.n), 1 << 18
        for a in range(0, len(shard.word), step):
            here = slice(a, a + step)
            w, v, p = shard.word[here], shard.context[here], np.searchsorted(shard.pairs, shard.pair[here])
            owner = np.searchsorted(ends, np.arange(a, a + len(w)), "right")
            share = words[0][w] / n
            for k, tokens in enumerate((n, m) if m else (n,)):
                loss = losses(words[2 * k][w], words[2 * k + 1][v], pairs[k][p], tokens, share)
                total[k] += np.bincount(owner, loss, len(shard.n))
        if not m:
            total[1] = total[0]
        background, target = total / np.maximum(shard.n, 1)
        none = shard.n == 0
        return pa.table([told.column("id"), pa.array(shard.n), *(pa.array(x, mask=none) for x in (background, target, target - background))], names=["id", *(f.name for f in FIELDS)])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *FIELDS])
    return answers.groupBy("shard").cogroup(texts.groupBy("shard")).applyInArrow(judge, schema).withColumnRenamed("id", id_col)
