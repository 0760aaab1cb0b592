"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, groups.

A fingerprint has 64 bits over the XXH64 hashes of a text's word shingles.  Two that
differ in at most four bits agree on at least two of six blocks, so each distinct
fingerprint is dealt out under all fifteen pairs of blocks (keys of 20 to 22 bits) and
compared within a key.  More fingerprints take longer keys, so that a key stays sparse:
three of seven blocks (27 to 29 bits, 35 keys) or four of eight (32 bits, 70 keys), with
the same links.  Only the links of a spanning forest leave a key, never all its
pairs.  A key with more than ``dense`` fingerprints is not compared pair by pair: its
fingerprints meet at common midpoints instead (two within four bits share a value at
two bits or fewer from both), which is linear in their number and exact as well.

Copies of one text share a fingerprint and count once, under the least id among them;
nothing is ever collected to the driver.

Defined results: a null or empty text, or one without words, has fingerprint zero and
links like any other; fewer words than a shingle: the whole sequence is one shingle.
A row with a null id keeps its fingerprint and gets the group of rows that share it
(null if there is none).  Repeated rows of one id are one document.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import near_copies
from eventloom.llm.common import cut_lineage, map_arrow, map_texts
from eventloom.llm.graph import components

SHINGLE = 4
SEED = 42
DISTANCE = 4
#: Blocks that a fingerprint is cut into, and up to how many distinct fingerprints; any
#: DISTANCE changed bits leave all but DISTANCE blocks whole, and those make a key.
BLOCKS = ((6, 1 << 26), (7, 1 << 33), (8, None))
#: More distinct fingerprints than this under one key go by midpoints.
DENSE = 20_000


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of every word shingle, repeats included; A-Z counts as a-z."""
    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= size:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    of = xxhash.xxh64_intdigest
    hashes = [of(joined[: ends[size - 1] - 1], SEED)]
    hashes += [of(joined[a : b - 1], SEED) for a, b in zip(ends, ends[size:], strict=False)]
    return hashes


def fingerprint(hashes: list[int]) -> np.uint64:
    """The bits that are set in over half of ``hashes``."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[k : k + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "fp") -> DataFrame:
    """(id, fp): the fingerprint of each row as a signed long, id cast to long."""

    def start():
        def make(buf, off):
            data, bounds = buf.tobytes(), off.tolist()
            return [np.array([fingerprint(shingle_hashes(data[a:b])) for a, b in zip(bounds, bounds[1:], strict=False)], np.uint64).view(np.int64)]

        return make

    return map_texts(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), "text", ["id"], [T.StructField(name, T.LongType())], start)


def _blocks(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``count`` blocks of nearly equal width."""
    at = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _keys(count: int) -> list:
    """The keys of column ``fp``, each of all but DISTANCE of ``count`` blocks, as longs that tell the choices apart."""
    block = lambda at, width: F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))
    out = []
    for i, chosen in enumerate(combinations(_blocks(count), count - DISTANCE)):
        key = F.lit(0).cast("long")
        for b in chosen:
            key = F.shiftleft(key, b[1]).bitwiseOR(block(*b))
        out.append(key.bitwiseOR(F.lit(i << 40)))
    return out


def blocks_for(fingerprints: int) -> int:
    """How many blocks keep the keys of so many fingerprints sparse."""
    return next(count for count, most in BLOCKS if most is None or fingerprints <= most)


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(keys: np.ndarray, fps: np.ndarray, most: int = DISTANCE) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links between equal ``keys`` (sorted)."""
    out: list[tuple[int, int]] = []
    parent, label = np.arange(len(keys)), np.arange(len(keys))
    at = np.arange(len(keys))
    lag = 0
    while len(at):
        lag += 1
        at = at[at + lag < len(keys)]
        at = at[keys[at] == keys[at + lag]]
        apart = at[label[at] != label[at + lag]]
        near = apart[np.bitwise_count(fps[apart] ^ fps[apart + lag]) <= most]
        if len(near):
            for i in near.tolist():
                a, b = _find(parent, i), _find(parent, i + lag)
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    out.append((i, i + lag))
            label = parent
            while (label != label[label]).any():
                label = label[label]
            parent = label.copy()
    return out


def _links(nodes: DataFrame, dense: int, blocks: int) -> DataFrame:
    """(u, v, fp): links between representatives; v null: u's fp lies under a dense key."""

    def run(batches):
        import pyarrow as pa

        held = [np.zeros(0, np.int64)] * 3
        over = None

        def out(rows):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["u", "v", "fp"])

        def close(key, fp, rep):
            return [(int(rep[i]), int(rep[j]), None) for i, j in forest(key, fp.view(np.uint64))]

        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if over is not None:
                n = int(np.searchsorted(new[0], over, "right"))
                yield from out([(int(r), None, int(f)) for f, r in zip(new[1][:n], new[2][:n], strict=True)])
                new = [x[n:] for x in new]
                if not len(new[0]):
                    continue
                over = None
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield from out(close(*(x[:last] for x in held)))
            held = [x[last:] for x in held]
            if len(held[0]) > dense:
                over = held[0][0]
                yield from out([(int(r), None, int(f)) for f, r in zip(held[1], held[2], strict=True)])
                held = [x[:0] for x in held]
        yield from out(close(*held))

    dealt = nodes.select(F.explode(F.array(*_keys(blocks))).alias("key"), "fp", "rep")
    return map_arrow(dealt.repartition("key").sortWithinPartitions("key", "fp"), run, "u long, v long, fp long")


def _midpoint_links(dense: DataFrame) -> DataFrame:
    """Links among ``dense`` (fp, rep) by values within two bits of both ends."""
    bit = lambda c: F.when(F.col(c) < 64, F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c))).otherwise(F.lit(0).cast("long"))
    first = dense.select("fp", "rep", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("i"))
    both = first.select("fp", "rep", "i", F.explode(F.sequence("i", F.lit(64))).alias("j")).where("i < j or i = 64")
    near = both.select(F.col("fp").bitwiseXOR(bit("i")).bitwiseXOR(bit("j")).alias("mid"), F.col("rep").alias("u"))
    least = near.groupBy("mid").agg(F.min("u").alias("v")).withColumnRenamed("mid", "at")
    return near.join(least, near.mid == least["at"]).where("u <> v").select("u", "v").distinct()


def links(nodes: DataFrame, dense: int = DENSE, blocks: int | None = None) -> DataFrame:
    """(u, v): links that join all of ``nodes`` (fp, rep) that chains of DISTANCE bits or fewer reach."""
    found = cut_lineage(_links(nodes.where("rep is not null"), dense, blocks or blocks_for(nodes.count())))
    near = found.where("v is not null").select("u", "v")
    crowded = found.where("v is null").select("fp", F.col("u").alias("rep")).distinct()
    return near if crowded.isEmpty() else near.unionByName(_midpoint_links(crowded))


def candidates(prints: DataFrame, dense: int = DENSE, blocks: int | None = None) -> DataFrame:
    """(u, v): pairs of ids of ``prints`` (id, fp) to verify, of a spanning forest of the fingerprints' links."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    same = prints.join(nodes, "fp").where("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    return same.unionByName(links(nodes, dense, blocks))


def groups(prints: DataFrame, dense: int = DENSE, blocks: int | None = None) -> DataFrame:
    """(fp, component): the least id that each distinct fp of ``prints`` (id, fp) reaches."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    labels = components(links(nodes, dense, blocks))
    return nodes.join(labels, nodes.rep == labels.id, "left").select("fp", F.coalesce("component", "rep").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE, blocks: int | None = None) -> DataFrame:
    """(id_col, fingerprint, component_id): one row for each row of ``docs``."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col))
    grouped = groups(prints, dense, blocks).withColumnRenamed("fp", "of")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(grouped, prints.fp == grouped.of).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = near_copies.SHINGLE, similarity: float = near_copies.SIMILARITY) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the least id; all columns stay.

    SimHash fingerprints of the texts' sets of ``size``-word shingles are linked as above, and
    links that an exact check of the similarity confirms make the first groups.  DISTANCE bits
    miss texts of a similarity of 0.8, and no number of blocks is both wide enough and cheap:
    ``near_copies`` then finds every link between different groups.
    """
    return near_copies.one_of_each(docs, id_col, text_col, size, similarity)
