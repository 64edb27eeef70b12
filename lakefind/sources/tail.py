"""The lines of a growing file as a stream whose offsets are bytes.

A micro-batch ends behind the last whole line, so a line that is half written waits. The range between two offsets is cut into parts that tasks read; a part has
the lines that begin in it. A file that is shorter than it was, or whose beginning is another, was begun anew and is read from its start.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "at long, line string"
#: Bytes of a part; of a step when the last line's end is looked for; of the beginning that a file is known by.
PART, STEP, HEAD = 64 << 20, 1 << 16, 1024
LAST = 300


def whole(path: str) -> int:
    """Bytes up to the end of the last whole line."""
    try:
        with open(path, "rb") as f:
            end = f.seek(0, os.SEEK_END)
            while end > 0:
                start = max(0, end - STEP)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
    except OSError:
        pass
    return 0


def known(path: str, n: int) -> dict:
    """An offset: n bytes of a file of this beginning."""
    n = max(0, n)
    try:
        with open(path, "rb") as f:
            head = f.read(min(n, HEAD))
    except OSError:
        head = b""
    return {"bytes": n, "head": len(head), "crc": zlib.crc32(head)}


def begin(path: str, start: dict, end: dict) -> int:
    """Where to read from: the start, or 0 if the file isn't the one any more that it was said of."""
    same = known(path, start["head"])
    return start["bytes"] if end["bytes"] >= start["bytes"] and same["crc"] == start["crc"] and same["head"] == start["head"] else 0


def lines(path: str, a: int, b: int) -> Iterator[tuple[int, str]]:
    """(at, line) of the lines that begin in [a, b); bytes that are no UTF-8 are replaced."""
    if a >= b:
        return
    with open(path, "rb") as f:
        at = a
        if a:
            f.seek(a - 1)
            at = a - 1 + len(f.readline())
        while at < b and (raw := f.readline()):
            yield at, raw.rstrip(b"\r\n").decode("utf-8", "replace")
            at += len(raw)


@dataclass
class Part(InputPartition):
    a: int
    b: int


def parts(a: int, b: int) -> list[Part]:
    return [Part(x, min(x + PART, b)) for x in range(a, b, PART)]


class TailStream(DataSourceStreamReader):
    def __init__(self, path: str, first: int):
        self.path, self.first = path, first

    def initialOffset(self) -> dict:
        return known(self.path, min(self.first, whole(self.path)))

    def latestOffset(self) -> dict:
        return known(self.path, whole(self.path))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return parts(begin(self.path, start, end), end["bytes"])

    def read(self, part: Part):
        yield from lines(self.path, part.a, part.b)


class TailReader(DataSourceReader):
    """Once: the lines behind an offset, or the last ones."""

    def __init__(self, path: str, after: int | None):
        self.path, self.after = path, after

    def partitions(self) -> list[Part]:
        end = whole(self.path)
        if self.after is not None:
            return parts(self.after if self.after <= end else 0, end) or [Part(0, 0)]
        start, found = end, 0
        with open(self.path, "rb") if end else open(os.devnull, "rb") as f:
            while start > 0 and found <= LAST:
                step = min(STEP, start)
                start -= step
                f.seek(start)
                found += f.read(step).count(b"\n")
            if found > LAST:
                f.seek(start)
                for _ in range(found - LAST):
                    f.readline()
                start = f.tell()
        return parts(start, end) or [Part(0, 0)]

    def read(self, part: Part):
        yield from lines(self.path, part.a, part.b)


class TailSource(DataSource):
    """Options: path; after: bytes to begin behind (for a stream 0 without it, else the last LAST lines)."""

    @classmethod
    def name(cls) -> str:
        return "lakefind_tail"

    def schema(self) -> str:
        return SCHEMA

    def _path(self) -> str:
        p = self.options["path"]
        return "/" + p.removeprefix("file:").lstrip("/") if p.startswith("file:") else p

    def streamReader(self, schema) -> TailStream:
        return TailStream(self._path(), int(self.options.get("after", 0)))

    def reader(self, schema) -> TailReader:
        after = self.options.get("after")
        return TailReader(self._path(), None if after is None else int(after))
