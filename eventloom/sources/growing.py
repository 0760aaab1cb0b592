"""A stream of the lines of growing files, by byte offsets.

An offset holds, for each file of a folder, how many of its bytes are read: up to the end of
its last whole line, so a line that is still being written waits.  A file that has become
shorter than its offset was truncated and is read anew from byte 0.  Offsets are in the
stream's checkpoint, so a restarted stream goes on where it stopped and repeats nothing.

Long stretches are cut into parts of ``SPLIT`` bytes that tasks read side by side: a part has
the lines that begin in it.  Files are reached through Arrow's file systems (local paths,
``file:``, ``hdfs:``, ``s3:`` and what else they open), which drivers and executors must
both reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from eventloom.plans.shipping import ship

SPLIT = 64 << 20
_READ = 1 << 20


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


@dataclass
class Stretch(InputPartition):
    """The lines of ``path`` that begin in [lo, hi); ``first``: where lines are known to begin."""

    path: str
    first: int
    lo: int
    hi: int
    end: int


def whole_lines(system: pafs.FileSystem, path: str, size: int) -> int:
    """The bytes of the first ``size`` up to the end of the last whole line."""
    with system.open_input_file(path) as f:
        while size:
            lo = max(0, size - _READ)
            block = f.read_at(size - lo, lo)
            at = block.rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            size = lo
    return 0


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, root = _opened(self.path)
        found = {}
        for info in system.get_file_info(pafs.FileSelector(root, recursive=False, allow_not_found=True)):
            if info.type != pafs.FileType.File or info.base_name.startswith((".", "_")) or not info.size:
                continue
            size, end = self.seen.get(info.path, (-1, 0))
            if size != info.size:
                end = whole_lines(system, info.path, info.size)
                self.seen[info.path] = (info.size, end)
            found[info.path] = end
        return found

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, to in sorted(end.items()):
            first = start.get(path, 0)
            first = 0 if to < first else first
            out += [Stretch(path, first, lo, min(lo + self.split, to), to) for lo in range(first, to, self.split)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        p = partition
        system, _ = _opened(self.path)
        with system.open_input_file(p.path) as f:
            at, held = p.lo, b""
            if p.lo > p.first:  # the line that runs over the border is the part's before
                at, held, skip = p.lo - 1, b"", True
            else:
                skip = False
            begins = at  # of ``held``
            while at < p.end:
                block = f.read_at(min(_READ, p.end - at), at)
                if not block:  # truncated while it was read: the next batch starts anew
                    return
                at += len(block)
                held += block
                if skip:
                    cut = held.find(b"\n") + 1
                    if not cut:
                        begins, held = at, b""
                        continue
                    begins, held, skip = begins + cut, held[cut:], False
                lines, places = [], []
                while (cut := held.find(b"\n", places[-1] if places else 0) + 1) and begins + (places[-1] if places else 0) < p.hi:
                    lines.append(held[places[-1] if places else 0 : cut - 1].rstrip(b"\r").decode("utf-8", "replace"))
                    places.append(cut)
                if lines:
                    yield pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])
                    begins, held = begins + places[-1], held[places[-1] :]
                if begins >= p.hi:
                    return

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """Format ``growing_lines``: option ``path``, a folder; ``split``, bytes a task."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("split", SPLIT)))


def lines(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """A stream (value) of the lines of the files in the folder ``path``."""
    ship(spark)
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", path).option("split", split).load()
