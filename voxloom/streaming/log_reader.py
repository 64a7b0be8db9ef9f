"""A stream of growing JSON-lines files, one partition a file.

Spark's file source reads a file once; a live training log grows in place. An offset is the size of
each file when it was looked at. A batch takes the lines whose end lies between two offsets, so a
half-written line waits for the batch that brings its end; a file that shrank is read anew. Which
files there are is asked of the file system through Arrow, so remote ones serve as well.
"""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file string, pos bigint, t double, event string, raw string"
#: Bytes that are read at once.
CHUNK = 1 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Stretch(InputPartition):
    """Bytes of a file whose line ends belong to a batch."""

    path: str
    start: int
    end: int


def line_start(f, at: int) -> int:
    """Where the line that is open at a place begins."""
    while at > 0:
        low = max(0, at - CHUNK)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def lines(part: Stretch) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that end in a stretch; nothing if the file is gone."""
    system, path = located(part.path)
    try:
        f = system.open_input_file(path)
    except OSError:
        return
    with f:
        at = line_start(f, part.start)
        f.seek(at)
        rest = b""
        while (read := at + len(rest)) < part.end:
            data = f.read(min(CHUNK, part.end - read))
            if not data:
                return
            *whole, rest = (rest + data).split(b"\n")
            for line in whole:
                yield at, line
                at += len(line) + 1


def parsed(path: str, rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple]:
    """Rows of the source; lines that hold no JSON object are left out."""
    for at, line in rows:
        text = line.decode("utf-8", "replace").strip()
        try:
            e = json.loads(text or "null")
        except json.JSONDecodeError:
            continue
        if isinstance(e, dict):
            t = e.get("t")
            yield (path, at, float(t) if isinstance(t, int | float) else None, e.get("event"), text)


class LogReader(DataSourceStreamReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        folder, _, name = self.pattern.rpartition("/")
        system, path = located(folder)
        prefix = folder[: -len(path)] if folder.endswith(path) else ""
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {prefix + i.path: i.size for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, name)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        parts = []
        for path, stop in end.items():
            before = int(start.get(path, 0))
            before = 0 if int(stop) < before else before
            if before < int(stop):
                parts.append(Stretch(path, before, int(stop)))
        return parts

    def read(self, part: Stretch) -> Iterator[tuple]:
        return parsed(part.path, lines(part))


class GrowingLog(DataSource):
    """Format growing_log; option path: folder/pattern of log files that all executors can read."""

    @classmethod
    def name(cls) -> str:
        return "growing_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLog)
