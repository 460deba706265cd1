"""Lines of files that grow: a streaming source with a place for each file.

Spark's own file sources take a file once. Here the offset of a batch says for each file how many of its bytes are
done, always up to the end of a line, so that a line still being written waits for its end, an appended one arrives
once, and a query that starts again from its checkpoint repeats nothing. Files are listed and read through pyarrow's
filesystems (local, HDFS, S3 and others), so paths have to be ones that driver and executors both reach.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file_path string, line_no long, line string"
#: Bytes looked at once for the last line's end, bytes of a task's range, and rows of a batch.
BLOCK, RANGE, ROWS = 1 << 16, 64 << 20, 5000


@dataclass
class Range(InputPartition):
    """Lines that begin in bytes low to high of a file."""

    path: str
    low: int
    high: int


def last_end(file: pa.NativeFile, size: int) -> int:
    """Where the last whole line within the first `size` bytes ends."""
    at = size
    while at > 0:
        low = max(0, at - BLOCK)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines_of(file: pa.NativeFile, low: int, high: int) -> Iterator[tuple[int, str]]:
    """(place, line) of lines that begin in [low, high); what comes before the first line's beginning is the range's before it."""
    at = low
    if low:
        file.seek(low - 1)
        while (block := file.read(BLOCK)) and b"\n" not in block:
            at += len(block)
        if not block:
            return
        at += block.index(b"\n")
    file.seek(at)
    rest = b""
    while at < high:
        block = file.read(BLOCK)
        parts = (rest + block).split(b"\n")
        rest = parts.pop()
        for line in parts:
            if at >= high:
                return
            yield at, line.removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line) + 1
        if not block:
            return


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.jsonl")
        self.from_end = options.get("start", "beginning") == "end"
        self.range = int(options.get("range", RANGE))

    def _ends(self) -> dict[str, int]:
        system, root = fs.FileSystem.from_uri(self.path)
        out = {}
        for f in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern):
                with system.open_input_file(f.path) as file:
                    out[f.path] = last_end(file, f.size)
        return out

    def initialOffset(self) -> dict:  # noqa: N802
        return self._ends() if self.from_end else {}

    def latestOffset(self) -> dict:  # noqa: N802
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for path, high in sorted(end.items()):
            low = start.get(path, 0)
            low = 0 if high < low else low  # a file that shrank was written anew
            out += [Range(path, a, min(a + self.range, high)) for a in range(low, high, self.range)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["file_path", "line_no", "line"])

        if not partition.path:
            return
        rows = []
        with fs.FileSystem.from_uri(self.path)[0].open_input_file(partition.path) as file:
            for row in lines_of(file, partition.low, partition.high):
                rows.append(row)
                if len(rows) == ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class GrowingLines(DataSource):
    """Options: path (a folder, as a path or an address), pattern of file names, start (beginning or end), range (bytes of a task)."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:  # noqa: N802
        return GrowingReader(dict(self.options))
