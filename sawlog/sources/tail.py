"""Following growing text files, and reading on from a bookmark.

Spark's file stream never looks at a file twice. This source keeps an offset per file, so an
append is read from where the last batch ended. A new inode under the same path, or a shorter
file, is read from its start.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sawlog.schema import MAX_LINE_BYTES

FORMAT = "sawlog_tail"
SCHEMA = "source string, file string, offset bigint, raw string, truncated boolean"
SPLIT_BYTES = 128 << 20
_READ_BYTES = 1 << 20


@dataclass
class FileRange(InputPartition):
    """The lines of ``path`` that start at ``[start, end)``."""

    path: str
    inode: int
    start: int
    end: int
    follow: bool
    max_line: int = MAX_LINE_BYTES


def _paths(options: dict) -> list[str]:
    return sorted({p for pattern in options["path"].split(",") for p in glob.glob(pattern.strip())})


def _last_newline(path: str, start: int, end: int) -> int:
    """Offset after the last line feed before ``end``; ``start`` if there is none."""
    with open(path, "rb") as file:
        while end > start:
            low = max(start, end - _READ_BYTES)
            file.seek(low)
            found = file.read(end - low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            end = low
    return start


def _sibling(path: str, inode: int) -> str | None:
    """Where a file is now that was under ``path``: a rotated file stays in its folder."""
    try:
        if os.stat(path).st_ino == inode:
            return path
    except FileNotFoundError:
        pass
    with os.scandir(os.path.dirname(path) or ".") as entries:
        return next((e.path for e in entries if e.inode() == inode), None)


def read_range(part: FileRange) -> Iterator[tuple]:
    """Rows of one range. A line belongs to the range its first byte is in.

    A file that was rotated after the range was planned is read under its new name; one that is gone raises an error.
    """
    if part.start >= part.end:
        return
    place = _sibling(part.path, part.inode)
    if place is None:
        raise FileNotFoundError(f"{part.path} (inode {part.inode}) was removed before bytes {part.start} to {part.end} were read")
    with open(place, "rb") as file:
        at = part.start
        if at > 0:
            file.seek(at - 1)
            if file.read(1) != b"\n":
                at += _skip_line(file)
        while at < part.end:
            line, size, ended = _read_line(file, part.max_line)
            if size == 0 or (part.follow and not ended):
                return
            body = line.rstrip(b"\n") if ended else line
            body = body[:-1] if body.endswith(b"\r") else body
            if body:
                cut = 0 < part.max_line < len(body)
                text = (body[: part.max_line] if cut else body).decode("utf-8", "replace")
                yield part.path, part.path, at, text, cut
            at += size


def _skip_line(file) -> int:
    skipped = 0
    while chunk := file.readline(_READ_BYTES):
        skipped += len(chunk)
        if chunk.endswith(b"\n"):
            break
    return skipped


def _read_line(file, limit: int) -> tuple[bytes, int, bool]:
    """One line, kept up to just past the limit if there is one; its full size; whether it ended in a line feed."""
    head = file.readline(limit + 2) if limit else file.readline()
    size, ended = len(head), head.endswith(b"\n")
    if ended:
        return head[:-1] + b"\n", size, True
    while chunk := file.readline(_READ_BYTES):
        size += len(chunk)
        if chunk.endswith(b"\n"):
            return head, size, True
    return head, size, False


def _splits(path: str, inode: int, start: int, end: int, follow: bool, max_line: int) -> list[FileRange]:
    return [
        FileRange(path, inode, low, min(low + SPLIT_BYTES, end), follow, max_line) for low in range(start, end, SPLIT_BYTES)
    ]


def _resume(known: dict, path: str, size: int, inode: int) -> int:
    """Where to go on: where this file was left, be it under another name; else at its start."""
    offset, old_inode = known.get(path, (0, inode))
    if path not in known or old_inode != inode:
        offset = next((o for o, i in known.values() if i == inode), 0)
    return offset if offset <= size else 0


def _rest_key(path: str, inode: int) -> str:
    """The name under which the rest of a rotated file is kept among the offsets."""
    return f"{path}|{inode}"


def _max_line(options: dict) -> int:
    return int(options.get("maxlinebytes", MAX_LINE_BYTES))


class TailReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.known = json.loads(options.get("startingoffsets", "{}"))

    def partitions(self):
        parts = []
        for path in _paths(self.options):
            stat = os.stat(path)
            start = _resume(self.known, path, stat.st_size, stat.st_ino)
            parts += _splits(path, stat.st_ino, start, stat.st_size, False, _max_line(self.options))
        return parts or [FileRange(os.devnull, -1, 0, 0, False)]

    def read(self, partition):
        return read_range(partition)


class TailStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = options
        self.per_batch = int(options.get("maxbytesperbatch", 0))
        self.seen = {p: tuple(v) for p, v in json.loads(options.get("startingoffsets", "{}")).items()}
        self.first = json.dumps(self.seen)

    def initialOffset(self):
        return json.loads(self.first)

    def latestOffset(self):
        """Every file up to its last whole line; ``maxBytesPerBatch`` bounds how much is new."""
        left = self.per_batch or None
        followed = _paths(self.options)
        for path in followed:
            try:
                stat = os.stat(path)
                self._keep_rest(path, stat.st_ino, followed)
                start = _resume(self.seen, path, stat.st_size, stat.st_ino)
                end = stat.st_size if left is None else min(stat.st_size, start + max(left, 0))
                stop = _last_newline(path, start, end)
                if stop == start and end < stat.st_size and (left is None or left > 0):
                    # One line longer than what is left: take it whole.
                    stop = _line_end(path, start, stat.st_size)
            except FileNotFoundError:
                continue
            if left is not None:
                left -= stop - start
            self.seen[path] = (stop, stat.st_ino)
        return {p: list(v) for p, v in self.seen.items()}

    def _keep_rest(self, path: str, inode: int, followed: list[str]) -> None:
        """A rotated file is finished from where it was left, unless it is followed under its new name."""
        offset, old = self.seen.get(path, (0, inode))
        if old == inode:
            return
        place = _sibling(path, old)
        if place is not None and place not in followed:
            size = os.stat(place).st_size
            if size > offset:
                self.seen[_rest_key(path, old)] = (size, old)

    def partitions(self, start: dict, end: dict):
        parts, known = [], {p: tuple(v) for p, v in start.items()}
        for name, (stop, inode) in end.items():
            self.seen.setdefault(name, (stop, inode))
            rest = name.endswith(f"|{inode}")
            path = name.removesuffix(f"|{inode}") if rest else name
            begin = _resume(known, name, stop, inode)
            parts += _splits(path, inode, begin, stop, not rest, _max_line(self.options))
        return parts or [FileRange(os.devnull, -1, 0, 0, True)]

    def read(self, partition):
        return read_range(partition)

    def commit(self, end: dict):
        self.seen.update({p: tuple(v) for p, v in end.items()})


def _line_end(path: str, start: int, size: int) -> int:
    with open(path, "rb") as file:
        file.seek(start)
        end = start + _skip_line(file)
        file.seek(end - 1)
        return end if end > start and file.read(1) == b"\n" else start


class TailSource(DataSource):
    """``path``: comma-separated globs on storage all executors see; ``startingOffsets``: JSON bookmarks; ``maxLineBytes``: 0 for no limit."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return TailReader(self._plain())

    def streamReader(self, schema):
        return TailStreamReader(self._plain())

    def _plain(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)


def log_tail(spark: SparkSession, path: str, starting_offsets: dict | None = None, max_bytes: int = 0):
    """Stream of the lines appended to files, from their start or from bookmarks."""
    register(spark)
    reader = spark.readStream.format(FORMAT).option("path", path)
    if starting_offsets:
        reader = reader.option("startingOffsets", json.dumps(starting_offsets))
    if max_bytes:
        reader = reader.option("maxBytesPerBatch", str(max_bytes))
    return reader.load()


def read_from_bookmark(spark: SparkSession, path: str, bookmark: dict | None = None):
    """Lines after a bookmark ``{file: [offset, inode]}``; all lines if the file is another one now.

    A last line without line feed is read too, as this read does not come back for it.
    """
    register(spark)
    reader = spark.read.format(FORMAT).option("path", path)
    return reader.option("startingOffsets", json.dumps(bookmark or {})).load()
