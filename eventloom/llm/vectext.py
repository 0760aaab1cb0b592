"""Words, lines and n-grams of many texts at once, as NumPy arrays over their UTF-8 bytes.

A Python string per word costs more than everything that is done with it, so the
operators that count or look up words work on positions and 64-bit hashes instead.
A hash is a polynomial over per-byte random constants, taken from prefix sums, and is
mixed at the end: equal byte runs have equal hashes, different ones collide with a
probability of about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Texts are worked on in slices of about this many bytes, so that arrays stay in cache.
SLICE = 1 << 20

SPACE, WORD, MARK = 0, 1, 2

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

#: Bytes that separate words: space and \x09 to \x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators, letters and digits (all bytes over 127 count as letters), other marks.
CLASSES = np.full(256, MARK, np.uint8)
CLASSES[IS_SPACE] = SPACE
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    CLASSES[_lo:_hi] = WORD
IS_UPPER = np.zeros(256, bool)
IS_UPPER[65:91] = True
IS_LOWER = np.zeros(256, bool)
IS_LOWER[97:123] = True


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, nulls as empty texts, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[off[0] : off[-1]], off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, 2 * SLICE)
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def segments(apart: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of False in ``apart`` that stay in one text."""
    n = len(apart)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~apart
    edge = np.empty(n, bool)
    edge[0] = True
    edge[1:] = apart[:-1]
    edge[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(inside & edge)
    edge[-1] = True
    edge[:-1] = apart[1:]
    last = off[1:] - 1
    edge[last[last >= 0]] = True
    return starts, np.flatnonzero(inside & edge) + 1


def runs(classes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of the runs of one class other than SPACE within a text."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(classes[1:], classes[:-1], out=new[1:])
    new[off[:-1][off[:-1] < n]] = True
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], n)
    kind = classes[starts]
    keep = kind != SPACE
    return starts[keep], ends[keep], kind[keep]


def per_text(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """n + 1 offsets into ``starts``: which of the runs are whose text's."""
    return np.searchsorted(starts, off)


def range_sums(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over the ranges [lo, hi)."""
    total = np.zeros(len(flags) + 1, np.int64 if flags.dtype.kind in "bui" else np.float64)
    np.cumsum(flags, out=total[1:])
    return total[hi] - total[lo]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each byte range; ``lower``: A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    table = _BYTES[_LOWER] if lower else _BYTES
    i, n = 0, len(starts)
    while i < n:
        lo = int(starts[i])
        j = int(np.searchsorted(ends, lo + 2 * SLICE, "right"))
        if j <= i:  # one run longer than two slices
            piece = buf[lo : int(ends[i])].tobytes()
            out[i] = xxhash.xxh64_intdigest(piece.lower() if lower else piece, seed=7)
            i += 1
            continue
        hi = int(ends[j - 1])
        up, down = _power(hi - lo)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[buf[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s])
        i = j
    return out


def grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive runs in each text, and offsets by text.

    ``first``: offsets of the texts into ``h``.  The k-th n-gram of a text starts at
    its k-th run; a text with fewer than ``n`` runs has none.
    """
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(offsets[-1]) + np.repeat(first[:-1] - offsets[:-1], counts)
    g = np.zeros(len(at), np.uint64)
    for k in range(n):
        g = mix(g * _BASE + h[at + k] + np.uint64(k + 1))
    return g, offsets


def owners(offsets: np.ndarray) -> np.ndarray:
    """For offsets of texts into a list, the text's number for each entry."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


class Counter:
    """Sums of rows of numbers by 64-bit key, held as sorted arrays and merged now and then."""

    def __init__(self, columns: int, pending: int = 1 << 20) -> None:
        self.columns, self.most = columns, pending
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((columns, 0), np.int64)
        self._new: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, keys: np.ndarray, values: list[np.ndarray]) -> None:
        unique, at = np.unique(keys, return_inverse=True)
        self._new.append((unique, np.stack([np.bincount(at, v, len(unique)).astype(np.int64) for v in values])))
        self._n += len(unique)
        if self._n > max(self.most, len(self.keys)):
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self._new)])
        sums = np.concatenate([self.sums, *(s for _, s in self._new)], axis=1)
        self._new, self._n = [], 0
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys = keys[heads]
        self.sums = np.add.reduceat(sums[:, order], heads, axis=1) if len(heads) else sums[:, :0]

    def __len__(self) -> int:
        return len(self.keys) + self._n

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """Everything so far, by key; afterwards the counter is empty."""
        self._merge()
        out = self.keys, self.sums
        self.keys, self.sums = np.zeros(0, np.uint64), np.zeros((self.columns, 0), np.int64)
        return out
