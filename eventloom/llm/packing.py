"""Vector bin packing of examples into training sequences.

A sequence has three limits at once: tokens, segments and loss-bearing tokens.  The
dot-product heuristic (Panigrahy et al. 2011) fills one sequence at a time: of the
examples that fit into what is left of all three, it takes the one whose demand vector
has the largest dot product with the room that is left.  Where cutting is allowed, an
example too long for a sequence first gives whole sequences, and when nothing fits any
more a piece is cut off to fill the rest.

Packing is a narrow pass: each task packs its own rows, a window of ``WINDOW`` examples
at a time, and carries what is left over to the next window, so memory is bounded and
only the last sequence of a task can be short.  A sequence id is the task's number and a
running number in it.

Defined results: a null or empty text is the end-of-text id alone; repeated rows are
examples of their own; an empty table gives an empty result; without cutting, an example
over a limit gets a sequence of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm import vectext as vt
from eventloom.llm.common import cut_lineage, map_arrow, row_slices

TOKENS = 2048
SEGMENTS = 128
END_ID = 1
WINDOW = 2048


class Packer:
    """Greedy sequences out of a pool of examples (tokens and loss-bearing tokens each)."""

    def __init__(self, tokens: int, segments: int, loss: int, cut: bool) -> None:
        self.limit = np.array([tokens, segments, loss])
        self.cut = cut
        self.example, self.start = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n, self.loss = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, example: np.ndarray, start: np.ndarray, n: np.ndarray, loss: np.ndarray) -> None:
        self.example, self.start, self.n, self.loss = (np.concatenate(x) for x in ((self.example, example), (self.start, start), (self.n, n), (self.loss, loss)))

    def __len__(self) -> int:
        return len(self.n)

    def sequences(self, leave: int):
        """Sequences as lists of (example, start, length), while over ``leave`` examples are left.

        Of a cut example every token of the piece counts as loss-bearing that still can.
        """
        alive = np.ones(len(self.n), bool)
        left = len(self.n)
        weight = self._weights()
        while left > leave:
            room = self.limit.copy()
            out = []
            while left and room[1] and room[0]:
                value = self.n * (weight[0] * room[0]) + self.loss * (weight[2] * room[2])
                fits = alive & (self.n <= room[0]) & (self.loss <= room[2])
                if fits.any():
                    i = int(np.argmax(np.where(fits, value, -1.0)))
                    take = int(self.n[i])
                    room -= (take, 1, int(self.loss[i]))
                    alive[i], left = False, left - 1
                elif self.cut and room[2]:
                    i = int(np.argmax(np.where(alive, value, -1.0)))
                    take = int(min(room[0], room[2], self.n[i]))
                    bears = min(int(self.loss[i]), take)
                    room -= (take, 1, bears)
                    self.n[i] -= take
                    self.loss[i] -= bears
                    if not self.n[i]:
                        alive[i], left = False, left - 1
                elif not out:  # over a limit by itself
                    i = int(np.flatnonzero(alive)[0])
                    take, room = int(self.n[i]), room * 0
                    alive[i], left = False, left - 1
                else:
                    break
                out.append((int(self.example[i]), int(self.start[i]), take))
                self.start[i] += take
            yield out
        for name in ("example", "start", "n", "loss"):
            setattr(self, name, getattr(self, name)[alive])

    def _weights(self) -> np.ndarray:
        """Weights of the dimensions: mean demand over the square of the limit."""
        if not len(self.n):
            return np.zeros(3)
        return np.array([self.n.mean(), 1.0, self.loss.mean()]) / self.limit.astype(float) ** 2


PIECES = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "segment", "padded")),
        T.StructField("ids", T.BinaryType()),
    ]
)


def padded(n: int, most: int) -> int:
    """The length a sequence of ``n`` ids is padded to: none at a power of two."""
    return n if n & (n - 1) == 0 else most


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = TOKENS) -> DataFrame:
    """Pieces of all documents: (id_col, start, length, doc_tokens, sequence_id, offset, segment, padded, ids).

    ``path``: the tokenizer file.  ``ids``: the piece's ids, little-endian unsigned 32-bit.
    All ids of a document bear loss but its first, which nothing precedes; ``loss`` is a
    sequence's limit of those (for raw text usually that of its tokens, so it doesn't bind).
    """
    from eventloom.llm.tokens import default_path

    path = path or default_path()
    schema = T.StructType([docs.schema[id_col], *PIECES.fields])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from eventloom.llm.tokens import tokenizer

        encode = tokenizer(path).encode
        end = np.array([END_ID], "<u4").tobytes()
        base, number = TaskContext.get().partitionId() << 32, 0
        packer = Packer(tokens, segments, loss, cut=True)
        kept: dict[int, tuple[object, int, int, bytes]] = {}  # id, ids in all, ids before the ones held, those
        serial, rows = 0, []

        def emit(sequence):
            nonlocal number
            total = padded(sum(n for _, _, n in sequence), tokens)
            at = 0
            for k, (example, start, n) in enumerate(sequence):
                name, size, before, ids = kept[example]
                rows.append((name, start, n, size, base + number, at, k, total, ids[4 * (start - before) : 4 * (start - before + n)]))
                at += n
            number += 1

        def out():
            if rows:
                columns = list(zip(*rows, strict=True))
                rows.clear()
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for a, b in row_slices(batch.column(1), vt.SLICE):
                buf, off = vt.buffers(batch.column(1).slice(a, b - a))
                data, bounds = buf.tobytes(), off.tolist()
                fresh = []
                for i in range(b - a):
                    ids = encode(data[bounds[i] : bounds[i + 1]]) + end
                    n = len(ids) // 4
                    whole = n - n % tokens if loss >= tokens else 0
                    kept[serial] = names[a + i], n, 0, ids
                    for start in range(0, whole, tokens):
                        emit([(serial, start, tokens)])
                    kept[serial] = names[a + i], n, whole, ids[4 * whole :]
                    if n > whole:
                        fresh.append((serial, whole, n - whole, n - whole - 1))
                    serial += 1
                if fresh:
                    packer.add(*(np.array(c, np.int64) for c in zip(*fresh, strict=True)))
                if len(packer) >= WINDOW:
                    for sequence in packer.sequences(WINDOW // 2):
                        emit(sequence)
                    kept = {k: kept[k] for k in set(packer.example.tolist())}
                elif not len(packer):
                    kept.clear()
                yield from out()
        for sequence in packer.sequences(0):
            emit(sequence)
        yield from out()

    return map_arrow(docs.select(docs[id_col], docs[text_col].cast("string").alias("text")), run, schema)


def pack_conversations(turns: DataFrame, path: str | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: int = TOKENS, segments: int = 16, loss: int = TOKENS // 2) -> DataFrame:
    """(id_col, sequence_id, offset, length, segments, loss): instruction examples, never cut.

    A conversation is one example: its turns are its segments and the tokens of the
    assistant's turns bear loss (each turn ends with one more token).  Rows without an id are
    one conversation; an example over a limit has a sequence of its own.  A task packs a window
    of ``WINDOW`` examples at a time and carries half of them over, so only its last sequences
    can be short, and the batches that rows come in don't matter.  Examples reach a task in the
    order in which executors send them, so another run may pack them otherwise: the result is
    checkpointed, and all that read it see the same sequences.
    """
    from eventloom.llm.tokens import default_path

    path = path or default_path()

    def sizes(batches):
        import pyarrow as pa

        from eventloom.llm.tokens import tokenizer

        encode = tokenizer(path).encode
        for batch in batches:
            n = [len(encode((x or "").encode())) // 4 + 1 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "role", "n"])

    kind = turns.schema[id_col].dataType.simpleString()
    sized = map_arrow(turns.select(turns[id_col].alias("id"), turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("text")), sizes, f"id {kind}, role string, n long")
    examples = sized.groupBy("id").agg(F.sum("n").alias("n"), F.count("*").alias("s"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("l"))

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 32, 0
        limit = np.array([tokens, segments, loss])
        pool: list[tuple[object, int, int, int]] = []

        def out(leave):
            nonlocal number, pool
            demands = np.array([x[1:] for x in pool], np.int64).reshape(-1, 3)
            rows, bins = [], vector_bins(demands, limit, leave)
            for sequence in bins:
                at = 0
                for i in sequence:
                    rows.append((pool[i][0], base + number, at, *pool[i][1:]))
                    at += pool[i][1]
                number += 1
            gone = {i for sequence in bins for i in sequence}
            pool = [x for i, x in enumerate(pool) if i not in gone]
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind_of), *(pa.array(x, pa.int64()) for x in columns[1:])], names=["id", "sequence_id", "offset", "length", "segments", "loss"])

        for batch in batches:
            kind_of = batch.schema.field(0).type
            for example in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                pool.append(example)
                if len(pool) == WINDOW:
                    yield out(WINDOW // 2)
        if pool:
            yield out(0)

    placed = map_arrow(examples, place, f"id {kind}, sequence_id long, offset long, length long, segments long, loss long")
    return cut_lineage(placed.withColumnRenamed("id", id_col))


def vector_bins(demands: np.ndarray, limit: np.ndarray, leave: int = 0) -> list[list[int]]:
    """Bins of whole items by the dot-product heuristic, while over ``leave`` items are left; an item over a limit is alone."""
    alive, out = np.ones(len(demands), bool), []
    weight = (demands.mean(axis=0) if len(demands) else np.zeros(len(limit))) / limit.astype(float) ** 2
    while alive.sum() > leave:
        room, own = limit.copy(), []
        while True:
            fits = alive & (demands <= room).all(axis=1)
            if not fits.any():
                break
            i = int(np.argmax(np.where(fits, demands @ (weight * room), -1.0)))
            own.append(i)
            alive[i] = False
            room = room - demands[i]
        if not own:
            i = int(np.flatnonzero(alive)[0])
            own, alive[i] = [i], False
        out.append(own)
    return out
