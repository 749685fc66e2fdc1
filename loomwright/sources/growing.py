"""Files that grow: a streaming source that takes up each file where it left off.

Spark's file source takes each path once, so lines appended to a file that it
has read never arrive. Here the offset is a byte position for every file: the
end of its last whole line. A torn last line waits for its end; a query that is
started again goes on from the positions in its checkpoint.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TAIL = 1 << 20  #: bytes read at once in search of a line's end
PIECE = 64 << 20  #: bytes of a file that one task reads
ROWS = 10_000  #: lines of a batch

SCHEMA = "file string, position long, value string"


@dataclass
class Stretch(InputPartition):
    """Lines of one file that begin at ``begin`` or later and before ``end``; ``first`` is where whole lines begin."""

    file: str
    first: int
    begin: int
    end: int
    last: int


def last_line_end(system: fs.FileSystem, file: str, known: int, size: int) -> int:
    """Position after the last newline between ``known`` and ``size``; ``known`` if there is none."""
    with system.open_input_file(file) as f:
        at = size
        while at > known:
            begin = max(known, at - TAIL)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return known


def whole_lines(f, stretch: Stretch) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin within the stretch, without their newlines."""
    at = stretch.begin
    f.seek(max(stretch.first, at - 1))
    if at > stretch.first:  # the byte before tells whether a line begins here
        at += -1
        held = b""
        skipping = True
    else:
        held, skipping = b"", False
    read = at
    while read < stretch.last or held:
        more = f.read(min(TAIL, stretch.last - read))
        if not more:
            return
        read += len(more)
        held += more
        lines = held.split(b"\n")
        held = lines.pop()
        for line in lines:
            if skipping:
                skipping = False
            elif at >= stretch.end:
                return
            else:
                yield at, line
            at += len(line) + 1
        if not skipping and at >= stretch.end:
            return


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _system(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        """The end of the last whole line of each file. A file that is gone or has become shorter keeps its position."""
        known = getattr(self, "known", {})
        system, top = self._system()
        for info in system.get_file_info(fs.FileSelector(top, recursive=True)):
            if info.type == fs.FileType.File and info.base_name[0] not in "._":
                before = known.get(info.path, 0)
                if info.size > before:
                    known[info.path] = last_line_end(system, info.path, before, info.size)
        self.known = known
        return {"files": json.dumps(known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        self.known = dict(before | now)
        out = []
        for file, last in sorted(now.items()):
            first = before.get(file, 0)
            out += [Stretch(file, first, at, min(at + PIECE, last), last) for at in range(first, last, PIECE)]
        return out

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        positions, lines = [], []

        def batch() -> pa.RecordBatch:
            texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(lines), pa.string()), pa.array(positions, pa.int64()), pa.array(texts, pa.string())], ["file", "position", "value"])

        with system.open_input_file(partition.file) as f:
            for at, line in whole_lines(f, partition):
                positions.append(at)
                lines.append(line)
                if len(lines) == ROWS:
                    yield batch()
                    positions, lines = [], []
        if lines:
            yield batch()


class GrowingLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(self.options["path"])


def stream_growing(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, value): each line below ``path`` once, with the byte where it begins, also if its file was read before it came.

    ``path`` is a folder (an absolute path or a URI that Arrow reads) of text
    files in UTF-8; names with a leading dot or underscore are passed over. A
    last line without its newline is taken when that has come. Files may only
    be appended to; one that has become shorter gives nothing until it is
    longer than before.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # Spark's worker beside the driver has no files sent to executors
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").load(path)
