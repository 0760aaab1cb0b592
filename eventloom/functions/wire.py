"""Binary forms: protobuf fields, CRC32C, BLAKE3, and Arrow decoders over whole batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from eventloom.plans.shipping import ship

#: Envelope fields by tag: name and kind (s text, b bytes, v varint, x fixed 64 bits).
ENVELOPE_TAGS = {
    1: ("full_name", "s"), 3: ("tier", "v"), 4: ("sev", "v"), 5: ("ts_ns", "x"), 6: ("trace_id", "s"), 7: ("span_id", "s"),
    8: ("parent_span_id", "s"), 9: ("service", "s"), 12: ("payload", "b"), 13: ("labels", "m"),
}
ENVELOPE_SCHEMA = "full_name string, tier long, sev long, ts_ns long, trace_id string, span_id string, parent_span_id string, service string, payload binary, labels map<string,string>"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """A value and the place after it; ValueError if it's cut off or over 64 bits."""
    value = shift = 0
    while at < len(data) and shift < 64:
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value & (2**64 - 1), at
        shift += 7
    raise ValueError("bad varint")


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(tag, wire type, value) of each field; ValueError if ``data`` is malformed."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        tag, kind = key >> 3, key & 7
        if kind == 0:
            value, at = read_varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        elif kind == 2:
            size, at = read_varint(data, at)
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        if at > len(data) or not tag:
            raise ValueError("cut off")
        yield tag, kind, value


def _bytes_field(tag: int, value: bytes) -> bytes:
    return varint(tag << 3 | 2) + varint(len(value)) + value


def encode_envelope(row: dict) -> bytes:
    """An envelope's bytes; empty and null values are left out."""
    out = b""
    for tag, (name, kind) in ENVELOPE_TAGS.items():
        v = row.get(name)
        if not v:
            continue
        if kind == "v":
            out += varint(tag << 3) + varint(v)
        elif kind == "x":
            out += varint(tag << 3 | 1) + struct.pack("<Q", v)
        elif kind == "m":
            for k, x in sorted(dict(v).items()):
                out += _bytes_field(tag, _bytes_field(1, k.encode()) + _bytes_field(2, (x or "").encode()))
        else:
            out += _bytes_field(tag, v.encode() if kind == "s" else bytes(v))
    return out


def decode_envelope(data: bytes) -> dict:
    """Envelope columns of ``data``; unknown tags are skipped, malformed bytes raise ValueError."""
    out: dict = dict.fromkeys(name for name, _ in ENVELOPE_TAGS.values()) | {"labels": {}}
    for tag, _, value in fields(data):
        name, kind = ENVELOPE_TAGS.get(tag, ("", ""))
        if kind == "m":
            pair = {t: v.decode("utf-8", "replace") for t, _, v in fields(value)}
            out["labels"][pair.get(1, "")] = pair.get(2, "")
        elif kind == "x":
            out[name] = struct.unpack("<Q", value)[0]
        elif kind:
            out[name] = value.decode("utf-8", "replace") if kind == "s" else value
    return out


def _crc_table() -> list[int]:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC = np.array(_crc_table(), np.uint32)


def crc32c_of(parts: list[bytes]) -> np.ndarray:
    """CRC-32C (Castagnoli) of many byte strings, one position of all of them at a time."""
    sizes = np.array([len(x) for x in parts], np.int64)
    order = np.argsort(-sizes, kind="stable")
    data = np.frombuffer(b"".join(parts), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[order]
    longest = sizes[order]
    c = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    for at in range(int(longest[0]) if len(parts) else 0):
        n = int(np.searchsorted(-longest, -at, "left"))  # strings longer than ``at``
        c[:n] = _CRC[(c[:n] ^ data[starts[:n] + at]) & 255] ^ (c[:n] >> np.uint32(8))
    out = np.empty_like(c)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c(data: bytes) -> int:
    """CRC-32C of one byte string."""
    return int(crc32c_of([data])[0])


#: BLAKE3's initial words and the order in which its message words move.
_IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
_MOVE = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
_LANES = ((0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15), (0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14))


def _compress(chain: tuple, block: bytes, counter: int, flags: int) -> tuple:
    m = struct.unpack("<16I", block.ljust(64, b"\0"))
    v = [*chain, *_IV[:4], counter & 0xFFFFFFFF, counter >> 32, len(block), flags]
    turn = lambda x, n: (x >> n | x << 32 - n) & 0xFFFFFFFF
    for _ in range(7):
        for i, (a, b, c, d) in enumerate(_LANES):
            for word, r1, r2 in ((m[2 * i], 16, 12), (m[2 * i + 1], 8, 7)):
                v[a] = (v[a] + v[b] + word) & 0xFFFFFFFF
                v[d] = turn(v[d] ^ v[a], r1)
                v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                v[b] = turn(v[b] ^ v[c], r2)
        m = tuple(m[i] for i in _MOVE)
    return tuple(v[i] ^ v[i + 8] for i in range(8))


def blake3(data: bytes) -> bytes:
    """The 32-byte BLAKE3 hash, from the published algorithm; for short inputs on the driver."""

    def chunk(part: bytes, number: int, root: int) -> tuple:
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        chain = _IV
        for i, b in enumerate(blocks):
            last = i == len(blocks) - 1
            chain = _compress(chain, b, number, (i == 0) | (last and 2) | (last and root))
        return chain

    def tree(lo: int, hi: int, root: int) -> tuple:
        if hi - lo == 1:
            return chunk(data[lo << 10 : hi << 10], lo, root)
        half = 1 << (hi - lo - 1).bit_length() - 1
        both = tree(lo, lo + half, 0) + tree(lo + half, hi, 0)
        return _compress(_IV, struct.pack("<16I", *both), 0, 4 | root)

    return struct.pack("<8I", *tree(0, max(1, -(-len(data) // 1024)), 8))


def id64(text: str) -> int:
    """The first eight bytes of the BLAKE3 hash as an unsigned number."""
    return int.from_bytes(blake3(text.encode())[:8], "little")


def encoded(envelopes: DataFrame, keep: list[str]) -> DataFrame:
    """(keep.., frame): each envelope as protobuf bytes; ``tier`` and ``sev`` as numbers."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([encode_envelope(r) for r in rows], pa.binary())], names=[*keep, "frame"])

    ship(envelopes.sparkSession)
    kept = ", ".join(f"{c} {envelopes.schema[c].dataType.simpleString()}" for c in keep)
    return envelopes.mapInArrow(run, f"{kept}, frame binary" if keep else "frame binary")


def _decoding(split):
    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in ENVELOPE_SCHEMA.replace("map<string,string>", "map").split(", ")]
        kinds = {"labels": pa.map_(pa.string(), pa.string()), "payload": pa.binary(), "tier": pa.int64(), "sev": pa.int64(), "ts_ns": pa.int64()}
        schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])
        for b in batches:
            for data in b.column(0):
                rows = []
                for frame in split(data.as_py() or b""):
                    try:
                        one = decode_envelope(frame)
                    except ValueError:
                        continue
                    rows.append(one | {"labels": list(one["labels"].items())})
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _whole(data: bytes) -> Iterator[bytes]:
    yield data


def _frames(data: bytes, most: int = 1 << 24) -> Iterator[bytes]:
    """Frames behind big-endian sizes; reading ends at one that is too long or cut off."""
    at = 0
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if size > most or at + 4 + size > len(data):
            return
        yield data[at + 4 : at + 4 + size]
        at += 4 + size


def _records(data: bytes) -> Iterator[bytes]:
    """Records behind a little-endian size and a CRC-32C; reading ends at the first bad one."""
    at, records, sums = 0, [], []
    while at + 8 <= len(data):
        size, crc = struct.unpack("<II", data[at : at + 8])
        if at + 8 + size > len(data):
            break
        records.append(data[at + 8 : at + 8 + size])
        sums.append(crc)
        at += 8 + size
    bad = np.flatnonzero(crc32c_of(records) != np.array(sums, np.uint32))
    yield from records[: bad[0] if len(bad) else None]


def _batch(data: bytes) -> Iterator[bytes]:
    """Envelopes of a batch message of format 0 or 3; others give none."""
    try:
        parts = list(fields(data))
    except ValueError:
        return
    if next((v for t, _, v in parts if t == 1), 0) in (0, 3):
        yield from (v for t, _, v in parts if t == 6)


_SPLITS = {"envelope": _whole, "frames": _frames, "records": _records, "batch": _batch}


def decoded(blobs: DataFrame, column: str, form: str) -> DataFrame:
    """The envelopes in binary ``column``: one each (``envelope``), or ``frames``, ``records``, ``batch``.

    Malformed envelopes are skipped; null and empty blobs give no rows.
    """
    ship(blobs.sparkSession)
    return blobs.select(column).mapInArrow(_decoding(_SPLITS[form]), ENVELOPE_SCHEMA)


def joined(frames: list[bytes], form: str) -> bytes:
    """Envelopes' bytes put together in the given form."""
    if form == "frames":
        return b"".join(len(f).to_bytes(4, "big") + f for f in frames)
    if form == "records":
        return b"".join(struct.pack("<II", len(f), int(c)) + f for f, c in zip(frames, crc32c_of(frames), strict=True))
    return varint(1 << 3) + varint(3) + b"".join(_bytes_field(6, f) for f in frames)
