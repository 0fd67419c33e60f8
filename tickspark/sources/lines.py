"""Lines of text files as a Spark data source, each with a number that says where it stands.

``seq`` is the file's number times 2 ** 40 plus the byte at which the line starts, so that it grows in file order and doesn't
depend on how files are split or packed into tasks. A file is read in byte ranges; a range has the lines that start in it.

In batch, files are numbered in the order of the given paths, those of a folder by name. In a stream they are numbered as they
come, by time of change and name; a file counts as complete when it shows up, and once it has lain for ``settle`` seconds.

Paths are local ones or URIs that Arrow's file systems open (file, hdfs, s3, gs, abfs); for others see ``ticks.read_lines``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bits of a line's place in its file, bytes of a range, and bytes read at once.
PLACE_BITS, RANGE, BLOCK = 40, 64 << 20, 1 << 20
SCHEMA = "seq long, value string, path string"
BATCH = pa.schema([("seq", pa.int64()), ("value", pa.string()), ("path", pa.string())])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change in ns) of a file, or of a folder's files by name; hidden ones and those of _names left out."""
    system, inner = opened(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((head + i.path, i.size, i.mtime_ns or 0) for i in found if i.is_file and not any(part.startswith(("_", ".")) for part in i.path.removeprefix(inner).split("/")))


def lines_in(path: str, start: int, end: int, block: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """(place of the first, lines) of those lines that start in [start, end), in stretches of bounded size."""
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        at = start
        if start:  # the line that holds the byte before belongs to the range before
            f.seek(start - 1)
            at -= 1
            while chunk := f.read(block):
                found = chunk.find(b"\n")
                at += found + 1 if found >= 0 else len(chunk)
                if found >= 0:
                    break
            f.seek(at)
        rest = b""
        while at < end:
            chunk = f.read(block)
            data = rest + chunk
            whole = len(data) if not chunk else data.rfind(b"\n") + 1
            if whole:
                lines = data[:whole].split(b"\n")
                lines = lines[:-1] if data[whole - 1 : whole] == b"\n" else lines
                yield at, lines
                at += whole
            rest = data[whole:]
            if not chunk:
                break


@dataclass
class Range(InputPartition):
    """A byte range of the file of a number."""

    number: int
    path: str
    start: int
    end: int


def ranges(files: list[tuple[str, int]], first: int, size: int) -> list[Range]:
    return [Range(first + i, path, at, min(n, at + size)) for i, (path, n) in enumerate(files) for at in range(0, n, size)]


def batches(part: Range) -> Iterator[pa.RecordBatch]:
    """The lines of a range."""
    for at, lines in lines_in(part.path, part.start, part.end):
        places, kept = [], []
        for line in lines:
            if at >= part.end:
                break
            places.append(part.number << PLACE_BITS | at)
            kept.append(line.removesuffix(b"\r").decode(errors="replace"))
            at += len(line) + 1
        if kept:
            yield pa.record_batch([pa.array(places, pa.int64()), pa.array(kept, pa.string()), pa.array([part.path] * len(kept), pa.string())], schema=BATCH)


class LinesReader(DataSourceReader):
    def __init__(self, paths: list[str], size: int):
        self.paths, self.size = paths, size

    def partitions(self) -> list[Range]:
        files = [(path, n) for given in self.paths for path, n, _ in listed(given)]
        return ranges(files, 0, self.size) or [Range(0, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition) if partition.end else iter(())


class LinesStream(DataSourceStreamReader):
    """Offsets are the last file taken, by time of change and name, and how many there were."""

    def __init__(self, path: str, size: int, settle: float):
        self.path, self.size, self.settle = path, size, settle

    def files(self) -> list[tuple[int, str, int]]:
        now = time.time_ns() - int(self.settle * 1e9)
        return sorted((changed, path, n) for path, n, changed in listed(self.path) if changed <= now)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": "", "files": 0}

    def latestOffset(self) -> dict:
        found = self.files()
        return {"changed": found[-1][0], "path": found[-1][1], "files": len(found)} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after, until = ((o["changed"], o["path"]) for o in (start, end))
        return ranges([(path, n) for changed, path, n in self.files() if after < (changed, path) <= until], start["files"], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return batches(partition)

    def commit(self, end: dict) -> None:
        pass


class Lines(DataSource):
    """Format ``ticklines``: seq, value, path. Options: path, or paths as a JSON list; range, the bytes of one; settle."""

    @classmethod
    def name(cls) -> str:
        return "ticklines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        given = self.options.get("paths")
        return LinesReader(json.loads(given) if given else [self.options["path"]], int(self.options.get("range", RANGE)))

    def streamReader(self, schema) -> LinesStream:
        return LinesStream(self.options["path"], int(self.options.get("range", RANGE)), float(self.options.get("settle", 1)))
