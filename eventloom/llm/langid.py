"""Language ID by fusing evidence: text, declared language, address suffix and host.

    log P(l | all) = log prior(l | host) + text evidence + log P(declared | l) + log P(suffix | l) + c

* Text: hashed trigrams of letters under one multinomial per language.  Neighbouring
  trigrams are not independent, so the log likelihood counts for at most
  ``TEXT_TRIGRAMS`` of them.  One more class, ``und``, is flat over all buckets: texts
  that look like no language fall to it.  The multinomials are learnt in two rounds: first
  from texts labelled by the function words in them (``SEEDS``), or else by what they
  declare; then anew from the labels that the text alone gets from the first round, where
  it is sure of them, so neither missing nor wrong declarations decide what a language is.
* Declared markup language and address suffix: their distribution given the language
  the text alone points to, from grouped counts with additive smoothing.
* Host priors: language counts by host, smoothed towards those of the host's domain,
  which are smoothed towards those of the whole table (grouped aggregation at each level).

All counts cover all documents, and every declared language (a tag of two or three
letters) is a class.  Broadcast are the multinomials, 128 KiB a language and at most
``PASS_LANGUAGES`` of them in a pass over the texts; the other tables are joined.

Defined results: a null or empty text gives no text evidence; null or malformed declared
languages, suffixes and hosts give none of theirs (a missing host gets the overall
prior).  A document without any evidence at all (no letters, nothing declared, no known
host) is ``und``.  Ties go to the language that comes first in the alphabet.  Without
declarations and seed words nothing can be learnt and every document is ``und``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import vectext as vt
from eventloom.llm.common import cut_lineage, dropped, free_name, map_arrow, map_texts, without_ids, written

BITS = 15
#: Languages whose multinomials are broadcast at once; more take more passes.
PASS_LANGUAGES = 256
TEXT_TRIGRAMS = 60
HOST_WEIGHT, DOMAIN_WEIGHT = 20.0, 100.0
#: A document with a lesser posterior probability of its best language is rejected.
MIN_CONFIDENCE = 0.5
UND = "und"
#: Frequent function words by language; a text with SEED_HITS of one language's, and twice as many as of any other's, is labelled by them.
SEEDS = {
    "de": "der die und das nicht ist ein eine mit auf für von dem den sich auch wird",
    "en": "the of and to in is that for was with are this from have which by",
    "es": "el los las que del una por con para es en como más pero sus",
    "fr": "le les des et une dans est pour que qui sur avec pas aux du",
    "it": "il che di della per non una sono gli con anche degli nel alla",
    "nl": "het een van en niet zijn voor met dat ook aan bij worden",
    "pt": "os das uma não para com mais dos foi pela são também ao",
}
SEED_HITS = 4
#: Nats a trigram by which a declared language without a list must fit its own texts better, each left out, than the list's language.
GAP = 0.25
#: Values of a declared tag, suffix or host that are broadcast, by languages: at most so many numbers, 16 MB.
MAX_BROADCAST_NUMBERS = 2_000_000
#: Share of the posterior by text alone from which the second round learns.
SURE = 0.9

_FOLD = np.full(256, 32, np.uint32)
for _lo, _hi in ((65, 91), (97, 123), (128, 256)):
    _FOLD[_lo:_hi] = np.arange(_lo, _hi)
_FOLD[65:91] += 32


def trigrams(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' letter trigrams (marks and digits count as blanks), and text numbers.

    Trigrams without a letter in their middle are left out.
    """
    if len(buf) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _FOLD[buf]
    at = np.flatnonzero(c[1:-1] != 32)
    owner = np.searchsorted(off, at, "right") - 1
    inside = at + 3 <= off[owner + 1]
    at, owner = at[inside], owner[inside]
    code = (c[at] << 16) | (c[at + 1] << 8) | c[at + 2]
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)).astype(np.int64), owner


def _clean(c: Column) -> Column:
    """The primary tag of a declared language: 'EN-us' gives 'en'; blank or malformed gives null."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def host_of(address: Column) -> Column:
    """The host of a URL, or the value itself where it isn't one; blank gives null."""
    bare = F.regexp_replace(F.lower(F.trim(address)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.nullif(F.regexp_replace(bare, r"[/:?#].*$", ""), F.lit(""))


class Seeds:
    """The language that the function words of each text point to."""

    def __init__(self, languages: list[str]) -> None:
        import pyarrow as pa

        some = [(languages.index(k), w) for k, words in SEEDS.items() if k in languages for w in words.split()]
        buf, off = vt.buffers(pa.array([w for _, w in some], pa.string()))
        h = vt.hashes(buf, off[:-1], off[1:], lower=True)
        order = np.argsort(h)
        self.words, self.of, self.n = h[order], np.array([k for k, _ in some], np.int64)[order], len(languages)

    def label(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The number of each text's language, -1 where its words don't tell."""
        n = len(off) - 1
        starts, ends, kind = vt.runs(vt.CLASSES[buf], off)
        starts, ends = starts[kind == vt.WORD], ends[kind == vt.WORD]
        if not len(self.words) or not len(starts):
            return np.full(n, -1)
        h = vt.hashes(buf, starts, ends, lower=True)
        lo, hi = np.searchsorted(self.words, h), np.searchsorted(self.words, h, "right")
        owner = np.searchsorted(off, starts, "right") - 1
        hits = np.zeros(n * self.n, np.int64)
        for k in range(int((hi - lo).max())):  # a word may stand in several lists
            some = lo + k < hi
            hits += np.bincount(owner[some] * self.n + self.of[lo[some] + k], minlength=n * self.n)
        hits = hits.reshape(n, self.n)
        best = hits.argmax(axis=1)
        top = hits[np.arange(n), best]
        hits[np.arange(n), best] = 0
        return np.where((top >= SEED_HITS) & (top >= 2 * hits.max(axis=1)), best, -1)


def _counts(docs: DataFrame, languages: list[str], labels, bits: int) -> np.ndarray:
    """Trigram counts [language, bucket] over ``docs`` (text, declared); ``labels`` makes the function that labels a slice."""
    n = len(languages)

    def run(batches):
        import pyarrow as pa

        from eventloom.llm.common import row_slices

        label = labels()
        counts = np.zeros(n << bits, np.int64)
        for batch in batches:
            for a, b in row_slices(batch.column(0), vt.SLICE):
                buf, off = vt.buffers(batch.column(0).slice(a, b - a))
                buckets, owner = trigrams(buf, off, bits)
                which = label(buf, off, batch.column(1).slice(a, b - a).to_pylist(), buckets, owner)
                language = which[owner]
                counts += np.bincount((language << bits | buckets)[language >= 0], minlength=n << bits)
        some = np.flatnonzero(counts)
        for k in range(0, len(some), 10_000):
            at = some[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    total = np.zeros(n << bits)
    for r in map_arrow(docs.select("text", "declared"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["at"]] = r["n"]
    return total.reshape(n, 1 << bits)


def _logs(counts: np.ndarray) -> np.ndarray:
    """Log probabilities [language and und, bucket]."""
    bits = counts.shape[1].bit_length() - 1
    p = (counts + 0.1) / (counts + 0.1).sum(axis=1, keepdims=True) if len(counts) else counts
    return np.vstack([np.log(p), np.full((1, 1 << bits), -bits * math.log(2))]).astype(np.float32)


def _evidence(table: np.ndarray, buckets: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled log likelihoods [text, class], and trigrams by text; ``table`` is [bucket, class]."""
    length = np.bincount(owner, minlength=n)
    sums = np.stack([np.bincount(owner, table[buckets, k], n) for k in range(table.shape[1])], axis=1)
    return sums * (np.minimum(length, TEXT_TRIGRAMS) / np.maximum(length, 1))[:, None], length


def _taken_for(docs: DataFrame) -> dict[str, str]:
    """For each declared language without a list: the list that over half of its texts that a list takes point to."""
    listed = sorted(SEEDS)

    def run(batches):
        import pyarrow as pa

        from eventloom.llm.common import row_slices

        seeds = Seeds(listed)
        for batch in batches:
            for a, b in row_slices(batch.column(0), vt.SLICE):
                seeded = seeds.label(*vt.buffers(batch.column(0).slice(a, b - a)))
                tags = batch.column(1).slice(a, b - a).filter(pa.array(seeded >= 0))
                yield pa.RecordBatch.from_arrays([tags, pa.array(seeded[seeded >= 0])], names=["tag", "seeded"])

    some = docs.where(F.col("declared").isNotNull() & ~F.col("declared").isin(listed)).select("text", "declared")
    tally = map_arrow(some, run, "tag string, seeded long").groupBy("tag", "seeded").agg(F.count("*").alias("n"))
    top = tally.groupBy("tag").agg(F.max(F.struct("n", -F.col("seeded"))).alias("top"), F.sum("n").alias("all"))
    return {r["tag"]: listed[-r["top"][1]] for r in top.where("2 * top.n > all").collect()}  # tags of two or three letters


def _neighbours(docs: DataFrame, bits: int) -> dict[str, str]:
    """Declared languages without a list that differ from the list's language their texts are taken for."""
    taken = _taken_for(docs) if docs.where(F.col("declared").isNotNull() & ~F.col("declared").isin(list(SEEDS))).limit(1).count() else {}
    out, tags = {}, sorted(taken)
    for k in range(0, len(tags), PASS_LANGUAGES):
        classes = [*sorted(SEEDS), *tags[k : k + PASS_LANGUAGES]]
        index = {x: i for i, x in enumerate(classes)}

        def labels(classes=classes, index=index):
            seeds = Seeds(classes)
            beside = np.array([index[taken[x]] if x in taken else -1 for x in classes], np.int64)

            def label(buf, off, declared, buckets, owner):
                seeded = seeds.label(buf, off)
                tag = np.array([index[x] if x in index and x in taken else -1 for x in declared], np.int64)
                other = np.array([x in taken for x in declared], bool)
                return np.where((seeded >= 0) & (tag >= 0) & (beside[tag] == seeded), tag, np.where(other, -1, seeded))

            return label

        counts = _counts(docs, classes, labels, bits)
        for x in classes[len(SEEDS) :]:
            own, near = counts[index[x]], counts[index[taken[x]]] + 0.1
            some, n = own > 0, own.sum()
            if n < 2:
                continue
            left_out = np.log((own[some] - 0.9) / (n - 1 + 0.1 * len(own)))
            if own[some] @ (left_out - np.log(near[some] / near.sum())) >= GAP * n:
                out[x] = taken[x]
    return out


def text_model(docs: DataFrame, declared: list[str], bits: int = BITS) -> tuple[list[str], np.ndarray]:
    """The languages found in ``docs`` (text, declared), and log probabilities [language and und, bucket].

    More than ``PASS_LANGUAGES`` languages are counted in as many passes as it takes.
    """
    languages = sorted({*declared, *SEEDS})
    index = {x: i for i, x in enumerate(languages)}
    neighbours = _neighbours(docs, bits)
    beside = np.array([index[neighbours[x]] if x in neighbours else -1 for x in languages], np.int64)

    def first(lo: int, hi: int):
        def labels():
            seeds = Seeds(languages)

            def label(buf, off, tags, buckets, owner):
                seeded, tag = seeds.label(buf, off), np.array([index.get(x, -1) for x in tags], np.int64)
                which = np.where((seeded < 0) | ((tag >= 0) & (beside[tag] == seeded)), tag, seeded)
                return np.where((which >= lo) & (which < hi), which - lo, -1)

            return label

        return labels

    passes = [(k, min(k + PASS_LANGUAGES, len(languages))) for k in range(0, len(languages), PASS_LANGUAGES)]
    counts = np.concatenate([_counts(docs, languages[lo:hi], first(lo, hi), bits) for lo, hi in passes])
    some = counts.sum(axis=1) > 0
    languages, counts = [x for x, is_some in zip(languages, some, strict=True) if is_some], counts[some]
    if len(languages) < 2:  # one class has nothing to be told from
        return languages, _logs(counts)
    if len(languages) > PASS_LANGUAGES:
        again = _recounted(docs, languages, counts, bits)
        again[again.sum(axis=1) == 0] = counts[again.sum(axis=1) == 0]
        return languages, _logs(again)
    shared = docs.sparkSession.sparkContext.broadcast(_logs(counts))

    def second():
        table = np.ascontiguousarray(shared.value.T)

        def label(buf, off, tags, buckets, owner):
            found, n = _evidence(table, buckets, owner, len(off) - 1)
            best = found.argmax(axis=1)
            sure = 1 / np.exp(found - found.max(axis=1, keepdims=True)).sum(axis=1) >= SURE
            return np.where(sure & (n > 0) & (best < len(languages)), best, -1)

        return label

    again = _counts(docs, languages, second, bits)
    again[again.sum(axis=1) == 0] = counts[again.sum(axis=1) == 0]
    return languages, _logs(again)


def _text_evidence(docs: DataFrame, keep: list[str], model: np.ndarray) -> DataFrame:
    """Columns ``keep``, the evidence by class and the number of trigrams."""
    bits = model.shape[1].bit_length() - 1
    parts = [model[k : k + PASS_LANGUAGES] for k in range(0, len(model), PASS_LANGUAGES)]
    for i, part in enumerate(parts):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def start(shared=shared):
            import pyarrow as pa

            table = np.ascontiguousarray(shared.value.T)

            def make(buf, off):
                sums, n = _evidence(table, *trigrams(buf, off, bits), len(off) - 1)
                offsets = pa.array(np.arange(len(off)) * table.shape[1], pa.int32())
                return [pa.ListArray.from_arrays(offsets, pa.array(sums.ravel())), n]

            return make

        last = i == len(parts) - 1
        held = [*keep, *(f"part{k}" for k in range(i))]
        fields = [T.StructField(f"part{i}", T.ArrayType(T.DoubleType())), T.StructField("n_trigrams", T.LongType())]
        docs = map_texts(docs, "text", held if last else [*held, "text"], fields, start)
        docs = docs if last else docs.drop("n_trigrams")
    return docs.select(*keep, F.concat(*(f"part{k}" for k in range(len(parts)))).alias("evidence"), "n_trigrams")


def _recounted(docs: DataFrame, languages: list[str], counts: np.ndarray, bits: int) -> np.ndarray:
    """The second round's counts of more languages than a task scores at once: texts are labelled and stored, then counted in passes."""
    found = _text_evidence(docs.select("text", F.col("text").alias("body")), ["body"], _logs(counts))
    top, best = F.array_max("evidence"), _argmax("evidence")
    share = 1 / F.aggregate("evidence", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    label = F.when((share >= SURE) & (F.col("n_trigrams") > 0) & (best < len(languages)), best).cast("string")
    labelled = written(found.select(F.col("body").alias("text"), label.alias("declared")), "labelled")

    def given(lo: int, hi: int):
        def labels():
            def label(buf, off, tags, buckets, owner):
                which = np.array([-1 if x is None else int(x) for x in tags], np.int64)
                return np.where((which >= lo) & (which < hi), which - lo, -1)

            return label

        return labels

    passes = [(k, min(k + PASS_LANGUAGES, len(languages))) for k in range(0, len(languages), PASS_LANGUAGES)]
    out = np.concatenate([_counts(labelled, languages[lo:hi], given(lo, hi), bits) for lo, hi in passes])
    dropped(docs.sparkSession, labelled)
    return out


def _vector(values) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def _given(observed: DataFrame, of: str, size: int) -> DataFrame:
    """(is, given): log P(value of ``of`` | language) for each value found, as an array over languages."""
    counts = [F.sum(F.when(F.col("guess") == k, 1).otherwise(0)) for k in range(size)]
    tallied = cut_lineage(observed.where(F.col(of).isNotNull()).groupBy(F.col(of).alias("is")).agg(F.array(*counts).alias("n")))
    total = tallied.agg(F.count("*"), *(F.sum(F.col("n")[k]) for k in range(size))).first()
    log = F.array(*(F.log((F.col("n")[k] + 0.5) / ((total[k + 1] or 0) + 0.5 * max(total[0], 1))) for k in range(size)))
    return tallied.select("is", log.alias("given"))


def _sized(side: DataFrame, size: int) -> DataFrame:
    """``side``, broadcast if it holds few enough numbers; else joined with a shuffle, where Spark splits a skewed value."""
    return F.broadcast(side) if side.count() * size <= MAX_BROADCAST_NUMBERS else side.hint("merge")


def _joined(df: DataFrame, of: str, given: DataFrame, name: str, size: int) -> DataFrame:
    """``df`` and ``given`` for its value of ``of`` as ``name``; zeros where there is none."""
    side = _sized(given.select(F.col("is").alias(f"{name}_of"), F.col("given").alias(name)), size)
    return df.join(side, F.col(of) == F.col(f"{name}_of"), "left").withColumn(name, F.coalesce(name, _vector([0.0] * size)))


def _host_priors(found: DataFrame, size: int) -> tuple[DataFrame, list[float]]:
    """(prior_host, prior): log priors by host, and those of the whole table."""
    sums = lambda: [F.sum(F.when(F.col("guess") == k, F.lit(1)).otherwise(0)).alias(f"n{k}") for k in range(size)]
    hosts = cut_lineage(found.where(F.col("host").isNotNull()).groupBy("host", "domain").agg(*sums()))
    totals = found.agg(*sums()).first()
    overall = [((totals[k] or 0) + 1.0) / (sum(totals[j] or 0 for j in range(size)) + size) for k in range(size)]
    domains = hosts.groupBy(F.col("domain").alias("of_domain")).agg(*(F.sum(f"n{k}").alias(f"d{k}") for k in range(size)))
    total = lambda x: sum((F.col(f"{x}{k}") for k in range(size)), F.lit(0))
    share = lambda k: (F.col(f"d{k}") + DOMAIN_WEIGHT * overall[k]) / (total("d") + DOMAIN_WEIGHT)
    joined = hosts.join(domains, hosts.domain == domains.of_domain)
    prior = F.array(*(F.log((F.col(f"n{k}") + HOST_WEIGHT * share(k)) / (total("n") + HOST_WEIGHT)) for k in range(size)))
    return _sized(joined.select(F.col("host").alias("prior_host"), prior.alias("prior")), size), [math.log(x) for x in overall]


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str | None = "lang", host_col: str | None = "source", keep: list[str] | None = None) -> DataFrame:
    """(id_col, [keep], lang_id, confidence, text_lang, accepted) for each row of ``docs``.

    ``declared_col``: a declared markup language; ``host_col``: a URL or host name, whose
    last label is the address suffix if it has two labels or more.  Either may be None.
    ``accepted`` is false for ``und`` and for confidences under ``MIN_CONFIDENCE``.
    """
    keep = [id_col] if keep is None else keep
    none = F.lit(None).cast("string")
    inner = docs.select(
        *(docs[c].alias(f"k{i}") for i, c in enumerate(keep)),
        docs[text_col].cast("string").alias("text"),
        (_clean(docs[declared_col].cast("string")) if declared_col else none).alias("declared"),
        (host_of(docs[host_col].cast("string")) if host_col else none).alias("host"),
    )
    inner = inner.withColumn("suffix", F.nullif(F.regexp_extract("host", r"\.([a-z]{2,})$", 1), F.lit("")))
    inner = inner.withColumn("domain", F.coalesce(F.nullif(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1), F.lit("")), F.lit("")))
    tags = [r[0] for r in inner.where("declared is not null").select("declared").distinct().collect()]  # tags of two or three letters
    languages, model = text_model(inner, tags)
    names, size = [*languages, UND], len(languages) + 1
    kept = [f"k{i}" for i in range(len(keep))]
    found = cut_lineage(_text_evidence(inner, [*kept, "declared", "host", "domain", "suffix"], model).withColumn("guess", _argmax("evidence")))
    sure = found.where("n_trigrams > 0")
    given = _joined(found, "declared", _given(sure, "declared", size), "by_tag", size)
    given = _joined(given, "suffix", _given(sure, "suffix", size), "by_suffix", size)
    priors, overall = _host_priors(sure, size)
    with_prior = given.join(priors, given.host == priors.prior_host, "left").withColumn("prior", F.coalesce("prior", _vector(overall)))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = with_prior.withColumn("fused", add(add(F.col("evidence"), F.col("prior")), add(F.col("by_tag"), F.col("by_suffix"))))
    blank = (F.col("n_trigrams") == 0) & F.col("prior_host").isNull() & ~F.coalesce(F.col("declared").isin(languages), F.lit(False)) & F.col("suffix").isNull()
    best = F.when(blank, F.lit(size - 1)).otherwise(_argmax("fused"))
    top = F.array_max("fused")
    scale = F.aggregate("fused", F.lit(0.0), lambda s, x: s + F.exp(x - top))
    label = lambda c: F.get(F.array(*(F.lit(x) for x in names)), c)
    out = fused.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)),
        label(best).alias("lang_id"),
        F.when(blank, F.lit(1.0)).otherwise(1 / scale).alias("confidence"),
        F.when(F.col("n_trigrams") > 0, label(F.col("guess"))).alias("text_lang"),
    )
    return out.withColumn("accepted", (F.col("lang_id") != UND) & (F.col("confidence") >= MIN_CONFIDENCE))


def _argmax(c: str) -> Column:
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """``docs`` without the rejected documents, row by row; all columns stay as they are."""
    key = free_name(docs.columns, "language_key")
    keyed = docs.withColumn(key, F.xxhash64(*(docs[c] for c in (id_col, text_col, declared_col, host_col))))
    verdicts = identify(keyed, key, text_col, declared_col, host_col)
    return without_ids(keyed, key, verdicts.where(~F.col("accepted")).select(key)).drop(key)
