"""Document fingerprints from prefix polynomial hashes.

A text's code points c_0, c_1, .. have the prefix hashes H[k] = c_0 B^(k-1) + .. + c_(k-1)
modulo 2**31 - 1, under two bases; the hash of any span is H[end] - H[start] B^length, so
equality of any two spans is one comparison (wrong with a probability of about 2**-60), and
the longest common extension of two positions is found by doubling steps down from the
largest power of two: a binary search over the same arrays.  ``PrefixHashes`` holds the
arrays of many texts at once and answers both for whole vectors of questions;
``spans_equal`` and ``common_extensions`` ask them for rows of a table.

A fingerprint is text: length, hash of the whole text, and two sketches of the hashes of all
spans of 16 (of a short text, 4) code points: the least hash in each of 128 (64) bins, a byte
each.  Of two fingerprints, ``likeness`` estimates the share of common spans (Jaccard), within
about 0.04; equal hashes and lengths give 1.  Texts under ``SHORT`` code points carry the fine
sketch too, and it is used if one of two texts has fewer than ``TINY``.

``edited`` pairs each document with the next one, by descending id and around the end.  Ids
are cut into ranges by quantiles that are ids of the table themselves, so each range lacks one
document, the one before it in ascending order, which is sent along: one shuffle of the texts,
no window over all rows.  An id that holds many ranges' worth of rows is dealt over as many
tasks.

Defined results: a null text counts as empty; an empty text has hash zero, no spans, and
likeness 1 to an empty text, 0 to others.  A text shorter than a span is one span.  Documents
that share an id have the same next document: of those with the next id, the one whose text
has the greatest XXH64.  Null ids come after all others (and are one id).  A single id is its
own next.  Invalid UTF-8 is read with replacement characters.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter as Multiset
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import vectext as vt
from eventloom.llm.common import free_name, map_arrow, row_slices

PRIME = (1 << 31) - 1
BASES = (1_372_581_733, 918_273_645)
#: (code points of a span, bins) of the coarse and the fine sketch.
COARSE, FINE = (16, 128), (4, 64)
#: Texts of fewer code points have a fine sketch; it is used if one text has fewer than TINY.
SHORT, TINY = 256, 64
#: Code points whose powers are held; longer texts go on from a carried hash.
_STRIDE = 4096
#: Code points (a multiple of it), or spans, that are worked on at once.
_BLOCK = 1 << 18
#: Bytes of text that are worked on at once.
_SLICE = 1 << 19
#: Most ranges of ids; else there are as many as the session's shuffle partitions.
MOST_RANGES = 20_000

_P = np.uint64(PRIME)
_31 = np.uint64(31)


def _mod(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2**31 - 1, for x below 2**63."""
    x = (x & _P) + (x >> _31)
    x = (x & _P) + (x >> _31)
    return np.where(x >= _P, x - _P, x)


def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**1 .. base**_STRIDE, and base**0, base**-1, .. as many."""
    up = list(accumulate(range(_STRIDE), lambda a, _: a * base % PRIME, initial=1))[1:]
    inverse = pow(base, -1, PRIME)
    down = list(accumulate(range(_STRIDE - 1), lambda a, _: a * inverse % PRIME, initial=1))
    return np.array(up, np.uint64), np.array(down, np.uint64)


_TABLES = [_powers(b) for b in BASES]


def _power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**exponent modulo 2**31 - 1, by squaring."""
    out, left, square = np.ones(len(exponents), np.uint64), exponents.astype(np.int64), base
    while left.any():
        out = np.where(left & 1, _mod(out * np.uint64(square)), out)
        left, square = left >> 1, square * square % PRIME
    return out


def prefix_array(codes: np.ndarray, which: int) -> np.ndarray:
    """H[0..n] of the code points ``codes`` under base number ``which``."""
    n, (up, down) = len(codes), _TABLES[which]
    out = np.zeros(n + 1, np.uint32)
    own_up = up * np.uint64(pow(BASES[which], -1, PRIME)) % _P
    whole, carry = int(up[-1]), 0
    for lo in range(0, n, _BLOCK):
        part = codes[lo : lo + _BLOCK]
        rows = -(-len(part) // _STRIDE)
        c = np.zeros(rows * _STRIDE, np.uint64)
        c[: len(part)] = part
        # sums of c_j B^-j within a row, times B^k: the row's own prefix hashes
        own = _mod(_mod(np.cumsum(_mod(c.reshape(rows, _STRIDE) * down), axis=1)) * own_up)
        carries = np.zeros(rows, np.uint64)
        for i, last in enumerate(own[:, -1].tolist()):
            carries[i] = carry
            carry = (carry * whole + last) % PRIME
        out[lo + 1 : lo + 1 + len(part)] = _mod(own + carries[:, None] * up).ravel()[: len(part)]
    return out


class PrefixHashes:
    """The prefix hashes of several texts, laid end to end; positions count code points.

    ``first``: where each text starts, and the end of the last.
    """

    def __init__(self, texts: list[str]) -> None:
        joined = "".join(texts).encode("utf-32-le", "surrogatepass")
        self.codes = np.frombuffer(joined, "<u4")
        self.first = np.append(0, np.cumsum([len(t) for t in texts], dtype=np.int64)).astype(np.int64)
        self.arrays = [prefix_array(self.codes + np.uint32(1), i) for i in range(len(BASES))]

    def spans(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """A number for each span of ``length`` from ``start``: equal for equal spans."""
        found = np.zeros(len(start), np.uint64)
        for base, h in zip(BASES, self.arrays, strict=True):
            power = np.uint64(pow(base, length, PRIME)) if isinstance(length, int) else _power(base, length)
            found = (found << np.uint64(32)) | _mod(h[start + length].astype(np.uint64) + _P * _P - h[start].astype(np.uint64) * power)
        return found

    def whole(self) -> np.ndarray:
        """The hash of each text; of an empty one, zero."""
        return self.spans(self.first[:-1], np.diff(self.first))

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` from positions ``a`` and ``b`` are the same."""
        return self.spans(a, length) == self.spans(b, length)

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, forward: bool = True) -> np.ndarray:
        """The longest common extension from ``a`` and ``b``, at most ``most``; backward: of what ends there."""
        a, b, most = (np.asarray(x, np.int64) for x in (a, b, most))
        got = np.zeros(len(a), np.int64)
        for k in range(int(most.max(initial=0)).bit_length() - 1, -1, -1):
            step = 1 << k
            at = np.flatnonzero(got + step <= most)
            back = 0 if forward else step
            sign = 1 if forward else -1
            x, y = (p[at] + sign * got[at] - back for p in (a, b))
            got[at[self.spans(x, step) == self.spans(y, step)]] += step
        return got

    def sketch(self, size: int, bins: int, chosen: np.ndarray) -> np.ndarray:
        """For the texts ``chosen`` the byte of the least span hash in each bin; 0: the bin is empty."""
        out = np.zeros((len(chosen), bins), np.uint8)
        lengths = np.diff(self.first)[chosen]
        counts = np.where(lengths < size, 0, lengths - size + 1)
        least = np.full(len(chosen) * bins, np.uint64(0xFFFFFFFFFFFFFFFF))
        ends = np.cumsum(counts)
        shift = self.first[chosen] - (ends - counts)
        for lo in range(0, int(counts.sum()), _BLOCK):
            at = np.arange(lo, min(lo + _BLOCK, int(ends[-1])))
            owner = np.searchsorted(ends, at, "right")
            self._least(least, bins, owner, self.spans(at + shift[owner], size))
        at = np.flatnonzero((lengths > 0) & (lengths < size))
        self._least(least, bins, at, self.spans(self.first[chosen[at]], lengths[at]))
        full = least != np.uint64(0xFFFFFFFFFFFFFFFF)
        # the bin is of the high bits; the least of them leaves the low bits spread
        out.reshape(-1)[full] = (vt.mix(least[full]) % np.uint64(255)).astype(np.uint8) + 1
        return out

    @staticmethod
    def _least(least: np.ndarray, bins: int, owner: np.ndarray, spans: np.ndarray) -> None:
        spread = vt.mix(spans)
        place = owner * bins + (spread >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
        np.minimum.at(least, place, spread)


class Prints:
    """The fingerprints of the texts of ``hashes``, in columns."""

    def __init__(self, hashes: PrefixHashes) -> None:
        self.n = np.diff(hashes.first)
        self.hash = hashes.whole()
        every = np.arange(len(self.n))
        self.coarse = hashes.sketch(*COARSE, every)
        self.fine = np.zeros((len(self.n), FINE[1]), np.uint8)
        short = np.flatnonzero(self.n < SHORT)
        self.fine[short] = hashes.sketch(*FINE, short)

    def texts(self) -> list[str]:
        out = []
        for n, h, c, f in zip(self.n.tolist(), self.hash.tolist(), self.coarse, self.fine, strict=True):
            out.append(f"{n:x}.{h:016x}.{c.tobytes().hex()}.{f.tobytes().hex() if n < SHORT else ''}")
        return out

    def take(self, at: np.ndarray) -> Prints:
        out = object.__new__(Prints)
        out.n, out.hash, out.coarse, out.fine = self.n[at], self.hash[at], self.coarse[at], self.fine[at]
        return out


def read_prints(prints: list[str]) -> Prints:
    """Fingerprints from their texts."""
    out = object.__new__(Prints)
    parts = [p.split(".") for p in prints]
    out.n = np.array([int(p[0], 16) for p in parts], np.int64)
    out.hash = np.array([int(p[1], 16) for p in parts], np.uint64)
    out.coarse = np.array([list(bytes.fromhex(p[2])) for p in parts], np.uint8).reshape(len(parts), COARSE[1])
    out.fine = np.array([list(bytes.fromhex(p[3]).ljust(FINE[1], b"\0")) for p in parts], np.uint8).reshape(len(parts), FINE[1])
    return out


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated share of common spans of two sketches; a byte agrees by chance in 1 of 255."""
    some = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    rate = same / np.maximum(some, 1)
    return np.clip((rate - 1 / 255) / (1 - 1 / 255), 0, 1)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """From 0 to 1 for each pair of fingerprints."""
    tiny = (np.minimum(a.n, b.n) < TINY) & (np.maximum(a.n, b.n) < SHORT)
    out = np.where(tiny, _shared(a.fine, b.fine), _shared(a.coarse, b.coarse))
    return np.where((a.n == b.n) & (a.hash == b.hash), 1.0, out)


def _strings(column: pa.Array) -> list[str]:
    data = column.cast(pa.large_binary()).to_pylist()
    return ["" if b is None else b.decode("utf-8", "replace") for b in data]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "fingerprint") -> DataFrame:
    """(id_col, n_chars, name) for each row, in one narrow pass."""
    inner = free_name([id_col], "text_")
    schema = T.StructType([docs.schema[id_col], T.StructField("n_chars", T.LongType()), T.StructField(name, T.StringType())])

    def run(batches):
        for batch in batches:
            for lo, hi in row_slices(batch.column(1), _SLICE):
                made = Prints(PrefixHashes(_strings(batch.column(1).slice(lo, hi - lo))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(made.n), pa.array(made.texts())], names=schema.names)

    return map_arrow(docs.select(docs[id_col], docs[text_col].cast("string").alias(inner)), run, schema)


def _asked(pairs: DataFrame, first: str, second: str, columns: list[str], field: T.StructField, answer) -> DataFrame:
    """``pairs`` and a column that ``answer(hashes, a, b, room, values of columns)`` gives for each row's two texts."""
    name = free_name(pairs.columns, field.name)
    schema = T.StructType([*pairs.schema.fields, T.StructField(name, field.dataType)])
    at = [pairs.columns.index(c) for c in (first, second, *columns)]

    def run(batches):
        for batch in batches:
            sizes = pa.compute.add(*(pa.compute.fill_null(pa.compute.binary_length(batch.column(i)), 0) for i in at[:2]))
            ends = np.cumsum(sizes.to_numpy(zero_copy_only=False))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _SLICE, "right")))
                part = batch.slice(lo, hi - lo)
                a, b = _strings(part.column(at[0])), _strings(part.column(at[1]))
                hashes = PrefixHashes([*a, *b])
                n, start = np.diff(hashes.first), hashes.first[:-1]
                values = [pa.compute.fill_null(part.column(i).cast(pa.int64()), 0).to_numpy(zero_copy_only=False) for i in at[2:]]
                made = answer(hashes, (start[: len(a)], n[: len(a)]), (start[len(a) :], n[len(a) :]), values)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made)], names=schema.names)
                lo = hi

    return map_arrow(pairs, run, schema)


def spans_equal(pairs: DataFrame, first: str, second: str, start_a: str, start_b: str, length: str) -> DataFrame:
    """``pairs`` and ``equal``: whether two texts' spans of ``length`` at the given starts are the same.

    A span that leaves its text, or has a negative start or length, equals none; null texts
    are empty and null numbers zero.
    """

    def answer(hashes, a, b, values):
        x, y, n = values
        inside = (x >= 0) & (y >= 0) & (n >= 0) & (x + n <= a[1]) & (y + n <= b[1])
        pick = lambda v: np.where(inside, v, 0)
        return hashes.equal(a[0] + pick(x), b[0] + pick(y), pick(n)) & inside

    return _asked(pairs, first, second, [start_a, start_b, length], T.StructField("equal", T.BooleanType()), answer)


def common_extensions(pairs: DataFrame, first: str, second: str, start_a: str, start_b: str) -> DataFrame:
    """``pairs`` and ``extension``: how many code points agree from the given starts on.

    Starts outside a text give 0; null texts are empty and null starts zero.
    """

    def answer(hashes, a, b, values):
        x, y = values
        inside = (x >= 0) & (y >= 0) & (x <= a[1]) & (y <= b[1])
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        return hashes.extension(a[0] + x, b[0] + y, np.where(inside, np.minimum(a[1] - x, b[1] - y), 0))

    return _asked(pairs, first, second, [start_a, start_b], T.StructField("extension", T.LongType()), answer)


def _ranges(docs: DataFrame, id_col: str, ranges: int) -> tuple[list[int], dict[int, int], int]:
    """Ascending upper ends of id ranges, the last the greatest id; how many tasks an id of many rows gets; the number of null ids."""
    key = docs.select(docs[id_col].cast("long").alias("k"))
    shares = [i / ranges for i in range(1, ranges + 1)]
    got = key.agg(F.percentile_approx("k", shares, 20 * ranges).alias("ends"), F.max("k").alias("last"), F.count_if(F.col("k").isNull()).alias("nulls")).first()
    often = Multiset(got["ends"] or [])
    hot = {k: n for k, n in often.items() if n > 1}
    ends = set(often) | ({got["last"]} if got["last"] is not None else set())
    if hot:
        before = key.agg(*(F.max(F.when(F.col("k") < k, F.col("k"))).alias(f"b{i}") for i, k in enumerate(hot))).first()
        ends |= {k for k in before if k is not None}
    return sorted(ends), hot, got["nulls"]


def _range_of(key, ends: list[int]):
    """How many of ``ends`` (ascending) are below ``key``: a search in two levels, both in the JVM."""
    step = max(1, int(len(ends) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda x: x < key))
    tops = F.lit(ends[step - 1 :: step]).cast("array<long>")
    block = below(tops)
    inner = F.slice(F.lit(ends).cast("array<long>"), block * step + 1, step)
    return block * step + below(inner)


def dealt(docs: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """(slot, lead, id, h, text): rows by range of ids, each range led by the documents before it.

    A lead row is the representative of the greatest id below the range (of the lowest range:
    of the null ids, or else of the greatest id of all).
    """
    ends, hot, nulls = _ranges(docs, id_col, ranges)
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")).withColumn("k", F.col("id").cast("long")).withColumn("h", F.xxhash64("text"))
    null_tasks = 0 if not nulls else max(1, len(ends) and -(-nulls * len(ends) // max(1, docs.count())) or ranges)
    counts = [null_tasks or 1, *(hot.get(k, 1) for k in ends)]  # of tasks: range 0 is that of the nulls
    base = list(accumulate(counts, initial=0))
    firsts = F.lit(base).cast("array<int>")
    span = F.lit(counts).cast("array<int>")
    number = F.when(F.col("k").isNull(), 0).otherwise(_range_of(F.col("k"), ends) + 1) if ends else F.lit(0)
    numbered = rows.withColumn("range", number)
    turn = F.pmod(F.monotonically_increasing_id(), F.get(span, F.col("range")).cast("long")).cast("int")
    main = numbered.select((F.get(firsts, F.col("range")) + turn).alias("slot"), F.lit(False).alias("lead"), "id", "h", "text")
    leaders = rows.where(F.col("k").isin(ends) | F.col("k").isNull()).groupBy("id").agg(F.max(F.struct("h", "text")).alias("m"))
    # the range after an id's own; after the greatest id that of the nulls, or else the lowest
    after = F.when(F.col("id").isNull(), 1).when(F.col("id") == (ends[-1] if ends else 0), 0 if nulls or not ends else 1).otherwise(_range_of(F.col("id"), ends) + 2 if ends else 0)
    if not ends:
        after = F.lit(0)
    led = leaders.withColumn("range", after).withColumn("one", F.explode(F.sequence(F.lit(0), F.get(span, F.col("range")) - 1)))
    lead = led.select((F.get(firsts, F.col("range")) + F.col("one")).alias("slot"), F.lit(True).alias("lead"), "id", F.col("m.h").alias("h"), F.col("m.text").alias("text"))
    return main.unionByName(lead).repartitionById(base[-1], F.col("slot")).sortWithinPartitions("slot", F.desc("lead"), F.asc_nulls_first("id"), F.desc("h"))


def edited_text(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following``, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_EDITED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    ``common_edited``, ``common_next``: the longest common extension of the two texts' starts.
    """
    ranges = min(MOST_RANGES, ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    fields = T.StructType.fromDDL(_EDITED).fields
    schema = T.StructType([docs.schema[id_col], *fields])

    def answers(ids: pa.Array, texts: list[str], follow: np.ndarray, extra: list[str]) -> pa.RecordBatch:
        """``follow``: for each text the place of its next document in ``texts`` + ``extra``."""
        every = texts + extra
        k = len(texts)
        changed = [edited_text(t, every[j]) for t, j in zip(texts, follow.tolist(), strict=True)]
        hashes = PrefixHashes([*every, *changed])
        prints = Prints(hashes)
        own, new = prints.take(np.arange(k)), prints.take(np.arange(len(every), len(every) + k))
        start, n = hashes.first[:-1], np.diff(hashes.first)
        mine, theirs = np.arange(k), np.arange(len(every), len(every) + k)
        common = [hashes.extension(start[mine], start[x], np.minimum(n[mine], n[x])) for x in (theirs, follow)]
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        near = [likeness(own, new), likeness(own, prints.take(follow))]
        made = [own.n, sha, own.texts(), new.texts(), *near, *common]
        return pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in made)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the representative of the id before the present one, and of the present one
        before, present, now = None, None, object()
        slot, led = None, False
        for batch in batches:
            for lo, hi in row_slices(batch.column(4), _SLICE):
                part = batch.slice(lo, hi - lo)
                slots, leads, ids = (part.column(i).to_pylist() for i in range(3))
                strings = _strings(part.column(4))
                rows, follow, extra = [], [], []
                held: dict[int, int] = {}  # places in ``extra`` of texts from outside this slice
                row_of: dict[int, int] = {}

                def place(entry: tuple[int | None, str]) -> tuple[bool, int]:
                    i, text = entry
                    if i is not None and i in row_of:
                        return True, row_of[i]
                    key = id(entry)
                    if key not in held:
                        held[key] = len(extra)
                        extra.append(text)
                    return False, held[key]

                kept = [before, present]  # entries stay alive, so that their ids stay distinct
                for i, (s, lead, key) in enumerate(zip(slots, leads, ids, strict=True)):
                    if s != slot:
                        slot, before, present, now = s, None, None, object()
                    if lead:
                        if present is None:
                            present, now = (None, strings[i]), key
                            led = True
                            kept.append(present)
                        continue
                    if led or key != now:
                        before, present, now = present, (i, strings[i]), key
                        led = False
                        kept.append(present)
                    row_of[i] = len(rows)
                    rows.append(i)
                    follow.append(place(before))
                k = len(rows)
                if k:
                    at = np.array([j if inside else k + j for inside, j in follow], np.int64)
                    yield answers(part.column(2).take(pa.array(rows)), [strings[i] for i in rows], at, extra)
                before, present = (e and (None, e[1]) for e in (before, present))

    return map_arrow(dealt(docs, id_col, text_col, ranges), run, schema)
