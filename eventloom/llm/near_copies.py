"""Near copies by SimHash, verified exactly, and a set-similarity join by prefixes for what its bits miss.

Two texts are near copies if the Jaccard similarity of their sets of word shingles is at
least ``SIMILARITY``.  First SimHash fingerprints of the sets are linked within a few bits
(``simhash.candidates``).  Other near copies differ in more bits: a join finds all that are
left.  Links of both are verified together and make groups.

Put all shingles in one order: then two such texts share one of
the first n - ceil(similarity * n) + 1 shingles of each (prefix filter), so a text is
dealt out under those alone and no pair is missed, however many bits its SimHash differs
in.  Sizes and places of the shared shingle rule out most pairs (length and positional
filter), parity sketches of the sets most others (each bit that differs stands for at
least one shingle that only one of them has); the rest are verified on their whole texts.
Any order gives the same result; ours is by hash, but puts those shingles last that too
many texts would be dealt out under, so that a passage which many documents share makes
no pairs of them.

What is shuffled: the keys of distinct texts (a fifth of their shingles, equal sets once
a task), twice, the sketches (a bit a shingle), and the texts of the few pairs to verify.

Sets under a key are compared there by small sketches, and only pairs
that these leave in the race go on.  They come in two rounds.  A key with at most ``FEW / 2``
such pairs a set emits them all in the first round and is done, however many sets it has.
One with more, as a large group of near copies has, emits those of a spanning forest of the
nearest and stays open; the second round takes the rest under open keys, but only across the
groups that the first has joined, so a large group of near copies doesn't emit its pairs.

No task holds a key of very many sets.  Keys that a batch of texts shows to be hot are
shuffled by key and set.  In the first round a key of more than ``BLOCK`` sets is cut into
blocks by hash, each with the same ``PIVOTS`` sets of the key, which join the blocks' forests:
its work is linear in the key's sets.  In the second, the sets outside the key's largest
group meet all its sets, block by block: nothing is left to do where the first round has
joined them all.

Defined results: null and empty texts, or texts without words, are copies of each other;
fewer words than a shingle: the whole sequence is one shingle.  A-Z counts as a-z.  Rows
with a null id are copies of nothing.  Repeated rows (one id, equal sets) are one document;
other texts under that id are documents of their own.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import vectext as vt
from eventloom.llm.common import MAX_BROADCAST_IDS, cut_lineage, flagged, free_name, map_arrow, map_texts, written
from eventloom.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
#: Shingles that so many texts would be dealt out under are put last; the most frequent FREQUENT of them at most.
CROWD, FREQUENT = 12, 1_000_000
#: Keys with half so many pairs a set, or fewer, emit all of them in the first round: any key of FEW sets does.
FEW = 8
#: Keys of more sets are cut into blocks of about so many, each with so many sets that all blocks have.
BLOCK, PIVOTS = 256, 16
#: Blocks of such keys in the second round, where a set is sent to every block that it meets.
ACROSS = 512
#: A key is hot if this share of a batch's texts has it (and HOT_ROWS at least); the HOT_KEYS most frequent are shuffled by set too.
HOT_SHARE, HOT_ROWS, HOT_KEYS = 0.001, 16, 100_000
#: Longs of the sketches by which sets are compared under a key.
PRINT = 8
#: Sets that a task remembers, to deal out equal ones once; beyond, it starts anew.
REMEMBERED = 100_000
#: Sizes and places are packed into one long: this many low bits for the place.
PLACE_BITS = 31

_LONGS = T.ArrayType(T.LongType())


def shingle_sets(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles of each text as sorted hashes, and n + 1 offsets by text."""
    starts, ends = vt.segments(vt.IS_SPACE[buf], off)
    h = vt.hashes(buf, starts, ends, lower=True)
    first = vt.per_text(starts, off)
    found, offsets = vt.grams(h, first, size)
    owner = vt.owners(offsets)
    n = np.diff(first)
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            at, g = first[short], np.full(len(short), k, np.uint64)
            for i in range(k):
                g = vt.mix(g * vt._BASE + h[at + i] + np.uint64(i + 1))
            found, owner = np.concatenate([found, g]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(off)))


def _signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash for each set."""
    sums = np.zeros(len(sets) + 1, np.uint64)
    np.cumsum(vt.mix(sets), out=sums[1:])
    n = np.diff(offsets).astype(np.uint64)
    return vt.mix((sums[offsets[1:]] - sums[offsets[:-1]]) ^ vt.mix(n))


def _lists(values: np.ndarray, offsets: np.ndarray):
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


class Seen:
    """Tells for each signature whether it is new in this task; forgets all when it holds too many."""

    def __init__(self, most: int = REMEMBERED) -> None:
        self.most, self.held = most, set()

    def new(self, signatures: np.ndarray) -> np.ndarray:
        out = np.zeros(len(signatures), bool)
        for i, x in enumerate(signatures.tolist()):
            if x not in self.held:
                out[i] = True
                self.held.add(x)
        if len(self.held) > self.most:
            self.held.clear()
        return out


def _only(sets: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets that are ``wanted``; the others empty."""
    n = np.diff(offsets)
    return sets[np.repeat(wanted, n)], np.concatenate([[0], np.cumsum(np.where(wanted, n, 0))])


def _frequent(plain: DataFrame, size: int, share: Fraction, crowd: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles under which ``crowd`` texts or more would be dealt out (sorted), and how many."""

    def start():
        seen = Seen()

        def make(buf, off):
            sets, offsets = shingle_sets(buf, off, size)
            mine = _only(sets, offsets, seen.new(_signatures(sets, offsets)))
            return [_lists(*prefixes(*mine, share, (np.zeros(0, np.uint64), np.zeros(0, np.int64))))]

        return make

    found = map_texts(plain, "text", ["id"], [T.StructField("s", _LONGS)], start).select(F.explode("s").alias("k"))
    crowded = cut_lineage(found.groupBy("k").count().where(F.col("count") >= crowd))
    rank = F.floor(F.log2("count") * 8)
    by_rank = crowded.groupBy(rank.alias("r")).agg(F.count("*").alias("n")).collect()  # 512 rows at most
    least, held = 0, 0
    for r in sorted(by_rank, reverse=True):
        held += r["n"]
        if held > FREQUENT:
            least = r["r"] + 1
            break
    top = crowded.where(rank >= least).toArrow()
    keys, counts = top["k"].to_numpy().astype(np.int64).view(np.uint64), top["count"].to_numpy()
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.int64)


def prefixes(sets: np.ndarray, offsets: np.ndarray, share: Fraction, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first shingles of each set in the common order, and offsets by text."""
    owner = vt.owners(offsets)
    keys, ranks = frequent
    rank = np.zeros(len(sets), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, sets), len(keys) - 1)
        rank = np.where(keys[at] == sets, ranks[at], 0)
    ordered = sets[np.lexsort((sets, rank, owner))]
    n = np.diff(offsets)
    most = np.where(n > 0, n + (-n * share.numerator // share.denominator) + 1, 0)
    at = np.concatenate([[0], np.cumsum(most)])
    return ordered[np.arange(at[-1]) + np.repeat(offsets[:-1] - at[:-1], most)], at


def _runs(batches):
    """Arrays of whole runs of the first column from sorted batches."""
    held = None
    for batch in batches:
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        if not len(held[0]):
            continue
        if held[0][0] == held[0][-1]:
            continue
        last = int(np.searchsorted(held[0], held[0][-1]))
        yield [x[:last] for x in held]
        held = [x[last:] for x in held]
    if held is not None and len(held[0]):
        yield held


def sketches(sets: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A parity sketch of each set: as many bits as shingles, up to a power of two, 64 at least.

    A bit tells whether an odd number of shingles falls on it, so two sketches differ in at
    most as many bits as there are shingles that only one of the sets has.  The upper half
    of a sketch, put on the lower one by exclusive or, is the sketch of half the size.
    """
    n = np.diff(offsets)
    bits = np.where(n > 64, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64)
    first = np.concatenate([[0], np.cumsum(bits)])
    owner = vt.owners(offsets)
    at = (vt.mix(sets) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64) + first[owner]
    odd = np.packbits(np.bincount(at, minlength=first[-1]) & 1 == 1, bitorder="little").tobytes()
    return [odd[a // 8 : b // 8] for a, b in zip(first, first[1:], strict=False)]


def prints(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Parity sketches of one size, ``PRINT`` longs each: rows of a matrix."""
    bits = 64 * PRINT
    at = (vt.mix(sets) & np.uint64(bits - 1)).astype(np.int64) + bits * vt.owners(offsets)
    odd = np.bincount(at, minlength=bits * (len(offsets) - 1)) & 1 == 1
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(-1, PRINT)


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded to the size of the other."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _hot(marked: DataFrame) -> DataFrame:
    """(hot): keys that a large share of some batch of ``marked`` (prefix) has."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            some = n >= max(HOT_ROWS, HOT_SHARE * batch.num_rows)
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(n[some])], names=["hot", "n"])

    found = map_arrow(marked.select("prefix"), run, "hot long, n long").groupBy("hot").agg(F.sum("n").alias("n"))
    return found.orderBy(F.desc("n"), "hot").limit(HOT_KEYS).select("hot")


def _shared(marked: DataFrame) -> DataFrame:
    """(key, n, sig, at): the prefixes of ``marked`` whose key two sets or more have, once each.

    A hot key's rows are dealt out by set as well; it needn't be counted, as many have it.
    The others come sorted by key, and a task holds no more than a batch of them.
    """
    hot = cut_lineage(_hot(marked))
    packed = F.shiftleft("n", PLACE_BITS) + F.col("at")
    rows = marked.select("n", "sig", F.posexplode("prefix").alias("at", "key")).join(F.broadcast(hot), F.col("key") == F.col("hot"), "left")
    dealt = rows.select("key", "sig", F.when(F.col("hot").isNull(), packed).otherwise(F.bitwise_not(packed)).alias("size"))

    def run(batches):
        import pyarrow as pa

        def out(key, sig, size):
            size = np.where(size < 0, ~size, size)
            columns = [key, size >> PLACE_BITS, sig, size & ((1 << PLACE_BITS) - 1)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["key", "n", "sig", "at"])

        last, alike = None, False  # the last row, and whether the one before has its key
        for batch in batches:
            rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(rows[0]):
                continue
            rows = rows if last is None else [np.concatenate(x) for x in zip(last, rows, strict=True)]
            key, sig, _ = rows
            new = np.append(True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]))
            key, sig, size = rows = [x[new] for x in rows]
            same = key[1:] == key[:-1]
            before = np.append(alike, same)
            keep = (before | np.append(same, False) | (size < 0))[:-1]
            if keep.any():
                yield out(*(x[:-1][keep] for x in rows))
            last, alike = [x[-1:] for x in rows], bool(before[-1])
        if last is not None and (alike or last[2][0] < 0):
            yield out(*last)

    by_set = F.when(F.col("size") < 0, F.col("sig"))
    return map_arrow(dealt.repartition("key", by_set).sortWithinPartitions("key", "size", "sig"), run, "key long, n long, sig long, at long")


def _block(of: str, blocks) -> Column:
    """The number of the block, of ``blocks``, that a set falls into."""
    return F.pmod(F.xxhash64(F.col(of), F.lit(1)), blocks)


def _blocks(dealt: DataFrame, huge: DataFrame) -> DataFrame:
    """(group, n, sig, at) for the first round: keys, those of ``huge`` (of, blocks) in blocks with the key's pivots."""
    rows = dealt.join(huge, dealt.key == huge.of, "left")
    own = F.when(F.col("of").isNull(), F.col("key")).otherwise(F.xxhash64("key", _block("sig", F.col("blocks"))))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("sig"), "sig"))
    pivots = rows.where("of is not null").withColumn("rank", rank).where(F.col("rank") <= PIVOTS)
    everywhere = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where(F.col("block") != _block("sig", F.col("blocks")))
    group = F.xxhash64("key", F.col("block").cast("long"))
    columns = ["n", "sig", "at"]
    return rows.select(own.alias("group"), *columns).unionByName(everywhere.select(group.alias("group"), *columns))


def _across(parted: DataFrame, huge: DataFrame) -> DataFrame:
    """(group, n, sig, at, part, side) for the second round: sets that meet others of another part.

    Side 0 meets side 0 of its group, and side 1, sets outside the key's largest part, meets side 2, all sets.
    """
    columns = ["n", "sig", "at", "part"]
    rows = parted.join(huge, parted.key == huge.of, "left")
    whole = rows.where("of is null").select(F.col("key").alias("group"), *columns, F.lit(0).alias("side"))
    cut = rows.where("of is not null")
    tally = cut.groupBy(F.col("key").alias("is"), "part").agg(F.count("*").alias("k"))
    split = tally.groupBy("is").agg(F.max(F.struct("k", "part")).alias("most"), F.sum("k").alias("all")).where(F.col("all") > F.col("most.k"))
    blocks = lambda k: F.ceil(k / ACROSS)
    cores = split.select("is", F.col("most.part").alias("core"), blocks(F.col("all") - F.col("most.k")).alias("lefts"), blocks(F.col("all")).alias("rights"))
    met = cut.join(cores, F.col("key") == F.col("is"))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    left = met.where(F.col("part") != F.col("core")).withColumn("l", _block("sig", F.col("lefts"))).withColumn("r", every("rights"))
    right = met.withColumn("r", _block("sig", F.col("rights"))).withColumn("l", every("lefts"))
    side = lambda of, k: of.select(F.xxhash64("key", "l", "r").alias("group"), *columns, F.lit(k).alias("side"))
    return whole.unionByName(side(left, 1)).unionByName(side(right, 2))


class _Race:
    """Which pairs of the sets under a key may be near copies, told by sizes, places and prints."""

    def __init__(self, n: np.ndarray, at: np.ndarray, marks: np.ndarray, share: Fraction) -> None:
        self.n, self.at, self.marks, self.a, self.b = n, at, marks, share.numerator, share.denominator

    def slack(self, i, j) -> np.ndarray:
        """Negative where the pair is out; the greater, the nearer the sets may be."""
        a, b, n, m = self.a, self.b, self.n[i], self.n[j]
        apart = np.maximum(np.bitwise_count(self.marks[i] ^ self.marks[j]).sum(axis=-1, dtype=np.int64), np.abs(n - m))
        need = -(-a * (n + m) // (a + b))
        out = np.minimum(n - self.at[i], m - self.at[j]) < need
        return np.where(out, -1, (b - a) * (n + m) - (a + b) * apart)


def _raced(race: _Race, group: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs within equal ``group`` (sorted) and of different parts that stay in the race, as places."""
    left, right, i, lag = [], [], np.arange(len(group)), 0
    while len(i):
        lag += 1
        i = i[i + lag < len(group)]
        i = i[group[i] == group[i + lag]]
        apart = i[part[i] != part[i + lag]]
        near = apart[race.slack(apart, apart + lag) >= 0]
        left.append(near)
        right.append(near + lag)
    return np.concatenate(left), np.concatenate(right)


def _forest(race: _Race, part: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Pairs of a spanning forest, nearest first (Prim), of the parts of the sets from ``lo`` to before ``hi``."""

    def nearness(i, rest):
        return np.where(part[rest] == part[i], np.iinfo(np.int64).max, race.slack(np.full(len(rest), i), rest))

    rest = np.arange(lo + 1, hi)
    best, by = nearness(lo, rest), np.full(len(rest), lo)
    left, right = [], []
    while len(rest):
        k = int(best.argmax())
        new, of = int(rest[k]), int(by[k])
        if best[k] >= 0 and part[new] != part[of]:
            left.append(of)
            right.append(new)
        rest, best, by = (np.delete(x, k) for x in (rest, best, by))
        if len(rest):
            near = nearness(new, rest)
            better = near > best
            best, by = np.where(better, near, best), np.where(better, new, by)
    return left, right


def _pairs(grouped: DataFrame, share: Fraction, first: bool) -> DataFrame:
    """(u, v): sets of ``grouped`` (group, n, sig, at, part, side, print) that may be near copies.

    All pairs are of different parts.  The ``first`` round takes all of groups that have few
    for their sets, and forests of the others, told by (group, null); the second takes all.
    """

    def run(batches):
        import pyarrow as pa

        found, held = [], 0

        def out():
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            u, v = np.minimum(u, v), np.maximum(u, v)
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            new = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))
            return pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new])], names=["u", "v"])

        for key, n, sig, at, part, side, marks in _runs(batches):
            race = _Race(n, at, np.frombuffer(b"".join(marks.tolist()), np.uint64).reshape(-1, PRINT), share)
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            if first:
                which = np.repeat(np.arange(len(sizes)), sizes)
                left, right = _raced(race, which, part)
                dense = 2 * np.bincount(which[left], minlength=len(sizes)) > FEW * sizes
                few = ~dense[which[left]]
                chosen = [(left[few], right[few])]
                chosen += [_forest(race, part, lo, lo + size) for lo, size in zip(starts[dense].tolist(), sizes[dense].tolist(), strict=True)]
                i, j = (np.concatenate(x).astype(np.int64) for x in zip(*chosen, strict=True))
                if len(i):
                    found.append((sig[i], sig[j]))
                    held += len(i)
                if dense.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[starts[dense]]), pa.nulls(int(dense.sum()), pa.int64())], names=["u", "v"])
                if held > 200_000:
                    yield out()
                    found, held = [], 0
                continue
            for lo, size in zip(starts.tolist(), sizes.tolist(), strict=True):
                if (part[lo : lo + size] != part[lo]).any():
                    rights = lo + np.flatnonzero(side[lo : lo + size] == 2)
                    for i in (lo + np.flatnonzero(side[lo : lo + size] < 2)).tolist():
                        j = rights if side[i] else np.arange(i + 1, lo + size)
                        j = j[part[j] != part[i]]
                        j = j[race.slack(np.full(len(j), i), j) >= 0] if len(j) else j
                        if len(j):
                            found.append((np.full(len(j), sig[i]), sig[j]))
                            held += len(j)
                        if held > 200_000:
                            yield out()
                            found, held = [], 0
        if found:
            yield out()

    columns = ["group", "n", "sig", "at", "part", "side", "print"]
    return map_arrow(grouped.select(*columns).repartition("group").sortWithinPartitions("group", "n", "sig"), run, "u long, v long").distinct()


def _near(pairs: DataFrame, marked: DataFrame, share: Fraction) -> DataFrame:
    """The ``pairs`` (u, v) that their sketches leave in the race."""
    side = lambda c: marked.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    a, b = share.numerator, share.denominator

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            u, v, nu, su, nv, sv = (batch.column(i) for i in range(6))
            most = (b - a) * (nu.to_numpy() + nv.to_numpy()) // (a + b)
            apart = [sketch_distance(x, y) for x, y in zip(su.to_pylist(), sv.to_pylist(), strict=True)]
            keep = np.array(apart, np.int64) <= most
            if keep.any():
                yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep)) for x in (u, v)], names=["u", "v"])

    joined = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "nu", "su", "nv", "sv")
    return map_arrow(joined, run, "u long, v long")


def _verified(pairs: DataFrame, plain: DataFrame, reps: DataFrame, share: Fraction, size: int) -> DataFrame:
    """The ``pairs`` (u, v) whose sets are similar enough, told from their texts.

    The texts are picked by a broadcast of at most ``MAX_BROADCAST_IDS`` ids, or else by a
    join with a shuffle.
    """
    pairs = cut_lineage(pairs)
    wanted = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("sig")).distinct().join(reps, "sig").select("sig", F.col("rep").alias("of")))
    n = wanted.count()
    if not n:
        return pairs
    wanted = F.broadcast(wanted) if n <= MAX_BROADCAST_IDS else wanted.hint("merge")
    some = plain.join(wanted, plain.id == F.col("of")).select("sig", "text")
    a, b = share.numerator, share.denominator

    def signed():
        def make(buf, off):
            return [_signatures(*shingle_sets(buf, off, size)).view(np.int64)]

        return make

    # Repeated rows of one id may have other texts: the one that is meant has the signature.
    told = map_texts(some, "text", ["sig", "text"], [T.StructField("is", T.LongType())], signed).where("sig = is").dropDuplicates(["sig"])
    texts = written(told.select("sig", "text"), "near-texts")

    def run(batches):
        import pyarrow as pa

        from eventloom.llm.common import row_slices

        for batch in batches:
            for lo, hi in row_slices(batch.column(2), vt.SLICE):
                part = batch.slice(lo, hi - lo)
                left, right = (shingle_sets(*vt.buffers(part.column(i)), size) for i in (2, 3))
                keep = np.zeros(hi - lo, bool)
                for i in range(hi - lo):
                    x, y = left[0][left[1][i] : left[1][i + 1]], right[0][right[1][i] : right[1][i + 1]]
                    keep[i] = (a + b) * len(np.intersect1d(x, y, assume_unique=True)) >= a * (len(x) + len(y))
                if keep.any():
                    yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(keep)) for i in range(2)], names=["u", "v"])

    side = lambda c: texts.select(F.col("sig").alias(c), F.col("text").alias(f"t{c}"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", "tu", "tv")
    return map_arrow(both, run, "u long, v long")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The copies (id, sig, component), and what more than one row has (id, sig)."""
    from eventloom.llm import simhash

    share = Fraction(similarity).limit_denominator(1000)
    plain = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).where("id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(_frequent(plain, size, share, CROWD))

    def start():
        import pyarrow as pa

        frequent, seen = shared.value, Seen()

        def make(buf, off):
            sets, offsets = shingle_sets(buf, off, size)
            sig, n = _signatures(sets, offsets).view(np.int64), np.diff(offsets)
            first = seen.new(sig)
            dealt, at = _only(sets, offsets, first)
            marks = sketches(dealt, at)
            small = [m.tobytes() for m in prints(dealt, at)]
            mixed = vt.mix(dealt)
            bits = np.array([simhash.fingerprint(mixed[a:b]) for a, b in zip(at, at[1:], strict=False)], np.uint64).view(np.int64)
            kept = lambda xs: pa.array([m if f else None for f, m in zip(first, xs, strict=True)], pa.binary())
            return [sig, n, _lists(*prefixes(dealt, at, share, frequent)), kept(marks), kept(small), bits]

        return make

    fields = [T.StructField("sig", T.LongType()), T.StructField("n", T.LongType()), T.StructField("prefix", _LONGS), T.StructField("sketch", T.BinaryType()), T.StructField("print", T.BinaryType()), T.StructField("fp", T.LongType())]
    marked = written(map_texts(plain, "text", ["id"], fields, start), "prefixes")
    reps = cut_lineage(marked.groupBy("sig").agg(F.min("id").alias("rep")))
    dealt = cut_lineage(_shared(marked))
    held = dealt.groupBy(F.col("key").alias("of")).agg(F.count("*").alias("size"))
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("size") / BLOCK))).cast("long")  # keys of the same sets have the same blocks
    huge = cut_lineage(held.where(F.col("size") > BLOCK).select("of", blocks.alias("blocks")))
    huge = F.broadcast(huge) if huge.count() <= MAX_BROADCAST_IDS else huge.hint("merge")
    sketched = cut_lineage(marked.where("sketch is not null").groupBy("sig").agg(F.max("n").alias("n"), F.max("sketch").alias("sketch"), F.max("print").alias("print"), F.max("fp").alias("fp")))
    verified = lambda pairs: cut_lineage(_verified(_near(pairs, sketched, share).distinct(), plain, reps, share, size))
    more = lambda joined, links: components(joined.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(links))
    part = F.coalesce("component", "sig").alias("part")
    printed = lambda rows: rows.join(sketched.select("sig", "print"), "sig")
    by_bits = simhash.candidates(sketched.select(F.col("sig").alias("id"), "fp"))
    alone = _blocks(dealt, huge).withColumn("part", F.col("sig")).withColumn("side", F.lit(0))
    found = cut_lineage(_pairs(printed(alone), share, True))
    joined = components(verified(by_bits.unionByName(found.where("v is not null"))))
    unsettled = found.where("v is null").select(F.col("u").alias("open")).unionByName(huge.select(F.col("of").alias("open"))).distinct()
    rest = dealt.join(unsettled, dealt.key == unsettled.open, "left_semi")
    parted = cut_lineage(rest.join(joined, rest.sig == joined.id, "left").select("key", "n", "sig", "at", part))
    mixed = parted.groupBy(F.col("key").alias("mixed")).agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi")
    parted = cut_lineage(parted.join(mixed, parted.key == mixed.mixed, "left_semi"))
    across = _across(parted, huge)
    labels = more(joined, verified(_pairs(printed(across), share, False)))
    nodes = reps.join(labels, reps.sig == labels.id, "left").select("sig", "rep", F.coalesce("component", "sig").alias("part"))
    least = nodes.groupBy(F.col("part").alias("is")).agg(F.min(F.struct("rep", "sig")).alias("least"))
    of = nodes.join(least, nodes.part == F.col("is")).select(F.col("sig").alias("of"), "least")
    copies = marked.join(of, marked.sig == F.col("of")).where((F.col("id") != F.col("least.rep")) | (F.col("sig") != F.col("least.sig")))
    return copies.select("id", "sig", F.col("least.rep").alias("component")).distinct(), marked.groupBy("id", "sig").count().where("count > 1").select("id", "sig")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, sig, component): documents that are near copies of another, and the least id of their group.

    ``sig`` is a hash of the document's set of shingles; the one document of a group that
    is not listed has the least id (and of several texts under that id the least hash).
    """
    return _grouped(docs, id_col, text_col, size, similarity)[0]


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies; all columns stay as they are.

    Rows whose id has no copy pass through untouched; only the others are read for their
    signatures again, and only what is left of those, of one id in rows alike, is shuffled.
    """
    copies, repeated = (cut_lineage(x) for x in _grouped(docs, id_col, text_col, size, similarity))
    some = copies.select("id").unionByName(repeated.select("id")).distinct()
    key, sig = free_name(docs.columns, "near_id"), free_name(docs.columns, "near_sig")
    marked = flagged(docs.withColumn(key, docs[id_col].cast("long")), key, some, sig)
    rest, touched = marked.where(~F.col(sig)).select(*docs.columns), marked.where(sig).drop(sig)

    def start():
        return lambda buf, off: [_signatures(*shingle_sets(buf, off, size)).view(np.int64)]

    signed = map_texts(touched, text_col, touched.columns, [T.StructField(sig, T.LongType())], start)
    gone = copies.select(F.col("id").alias("gone_id"), F.col("sig").alias("gone_sig"))
    left = signed.join(gone.select(F.struct("gone_id", "gone_sig").alias(free_name(signed.columns, "gone"))), F.struct(key, sig) == F.col(free_name(signed.columns, "gone")), "left_anti")
    return rest.unionByName(left.dropDuplicates([key, sig]).select(*docs.columns))
