"""A log of generations: numbered entries of which each is made once, by whoever comes first.

An entry is written beside the log and then put under its number in one step that fails if the number is taken; so of two writers from one parent
one wins. Readers take the newest entry that is whole; a writer that dies leaves nothing under a number.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has published from the same parent."""


class Log:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        fs, path = self._path()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def entry(self, number: int) -> dict | None:
        """An entry, None if it isn't whole."""
        fs, path = self._path(f"{number}.json")
        try:
            stream = fs.open(path)
            try:
                raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
            found = json.loads(raw)
            return found if isinstance(found, dict) and found.get("generation") == number else None
        except Exception:  # a missing or torn entry is no entry, whatever the file system says of it
            return None

    def newest(self) -> dict:
        """The newest whole entry; empty before the first."""
        return next((e for n in reversed(self.numbers()) if (e := self.entry(n)) is not None), {})

    def append(self, parent: dict, entry: dict) -> dict:
        """Publish an entry whose parent is the newest one still. Conflict if it isn't, or if another writer comes first."""
        number = parent.get("generation", 0) + 1
        last = self.newest().get("generation", 0)
        if last != number - 1:
            raise Conflict(f"generation {last} is newer than {number - 1}")
        entry = entry | {"generation": number, "parent": number - 1}
        fs, folder = self._path()
        fs.mkdirs(folder)
        draft = f"draft-{uuid.uuid4().hex}"
        _, path = self._path(draft)
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            self._put(draft, f"{number}.json")
        finally:
            fs.delete(path, False)
        return entry

    def _put(self, draft: str, name: str) -> None:
        fs, path = self._path(draft)
        _, to = self._path(name)
        if str(fs.getScheme()) == "file":
            try:
                # a link fails if its name is taken, a rename wouldn't
                os.link(str(path.toUri().getPath()), str(to.toUri().getPath()))
            except FileExistsError:
                torn = name[:-5].isdigit() and self.entry(int(name[:-5])) is None
                raise Conflict(f"{name} is taken{' by a torn entry' if torn else ''}") from None
            return
        if fs.exists(to) or not fs.rename(path, to):  # the file systems' own rename doesn't replace
            raise Conflict(f"{name} is taken")
