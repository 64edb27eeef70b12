"""A folder's files as a table that is never opened: path, size and time from the file system alone, listed by tasks, a part of the tree each.

Filters on folder, extension and time reach the listing: folders that can't hold a wanted file aren't entered. What a file holds is read
by tasks too, file by file, and only for the files that are asked for.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith

SCHEMA = "path string, folder string, extension string, size long, mtime_ns long"
#: Parts that the tree is split into, about; folders below so many levels aren't split further.
PARTS, LEVELS = 64, 4


def _local(root: str) -> str | None:
    """The path of a local folder, None for another file system's."""
    if root.startswith("file:"):
        return "/" + root.removeprefix("file:").lstrip("/")
    return root if "://" not in root else None


def _children(root: str, folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether a folder, size, time) of what lies in a folder under root; hidden names and what can't be looked at are left out."""
    local = _local(root)
    if local is not None:
        try:
            with os.scandir(os.path.join(local, folder)) as it:
                for e in it:
                    if e.name[0] in "._":
                        continue
                    try:
                        s = e.stat()
                    except OSError:
                        continue
                    yield e.name, e.is_dir(), s.st_size, s.st_mtime_ns
        except OSError:
            return
        return
    from pyarrow import fs

    there, base = fs.FileSystem.from_uri(f"{root}/{folder}" if folder else root)
    for i in there.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if i.base_name[0] not in "._":
            yield i.base_name, i.type == fs.FileType.Directory, i.size or 0, i.mtime_ns or 0


@dataclass
class Part(InputPartition):
    folder: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")
        self.folders: list[tuple[str, bool]] = []  # (folder, exactly): what a file's folder must be or begin with
        self.extensions: set[str] | None = None
        self.since = 0

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else ""
            if isinstance(f, EqualTo) and column == "folder":
                self.folders.append((f.value, True))
            elif isinstance(f, StringStartsWith) and column == "folder":
                self.folders.append((f.value, False))
            elif isinstance(f, (EqualTo, In)) and column == "extension":
                some = set(f.value) if isinstance(f, In) else {f.value}
                self.extensions = some if self.extensions is None else self.extensions & some
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column == "mtime_ns":
                self.since = max(self.since, f.value + isinstance(f, GreaterThan))
            else:
                yield f

    def _wanted(self, folder: str) -> bool:
        return all(folder == x if exact else folder.startswith(x) for x, exact in self.folders)

    def _enter(self, folder: str) -> bool:
        """Whether a file below the folder may be wanted."""
        inside = folder + "/" if folder else ""
        return all(x == folder or x.startswith(inside) if exact else inside.startswith(x) or x.startswith(inside) for x, exact in self.folders)

    def partitions(self) -> list[Part]:
        """Folders are opened level by level until there are enough of them; what was opened gives its own files only."""
        parts, level = [], [""]
        for _ in range(LEVELS):
            if not level or len(level) + len(parts) >= PARTS:
                break
            below = []
            for folder in level:
                parts.append(Part(folder, False))
                inside = f"{folder}/" if folder else ""
                below += [inside + name for name, is_dir, _, _ in _children(self.root, folder) if is_dir and self._enter(inside + name)]
            level = below
        return parts + [Part(folder, True) for folder in level]

    def read(self, part: Part):
        stack = [part.folder]
        while stack:
            folder = stack.pop()
            for name, is_dir, size, mtime in _children(self.root, folder):
                path = f"{folder}/{name}" if folder else name
                if is_dir:
                    if part.deep and self._enter(path):
                        stack.append(path)
                    continue
                ext = "." + name.rpartition(".")[2].lower() if "." in name else ""
                if self._wanted(folder) and mtime >= self.since and (self.extensions is None or ext in self.extensions):
                    yield path, folder, ext, size, mtime


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lakefind_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """SCHEMA of the files under root; no file is opened."""
    spark.dataSource.register(FolderSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("lakefind_folder").load(root)


def opened(root: str, path: str) -> bytes | None:
    """What a file holds; None if it can't be read."""
    local = _local(root)
    try:
        if local is not None:
            with open(os.path.join(local, path), "rb") as f:
                return f.read()
        from pyarrow import fs

        there, name = fs.FileSystem.from_uri(f"{root}/{path}")
        with there.open_input_stream(name) as f:
            return f.read()
    except OSError:
        return None


def contents(files: DataFrame, root: str) -> DataFrame:
    """files (…, path) with content, read one at a time."""
    names = files.columns

    def run(batches):
        for b in batches:
            for k in range(len(b)):
                yield b.iloc[k : k + 1].assign(content=[opened(root, b["path"].iloc[k])])[[*names, "content"]]

    fields = ", ".join(f"`{c}` {t}" for c, t in files.dtypes)
    return files.mapInPandas(run, f"{fields}, content binary")


def hashes(files: DataFrame, root: str) -> DataFrame:
    """(path, content_hash) of files; null where a file can't be read."""

    def run(batches):
        for b in batches:
            found = (opened(root, p) for p in b["path"])
            yield pd.DataFrame({"path": b["path"], "content_hash": [None if x is None else hashlib.sha256(x).hexdigest() for x in found]})

    return files.select("path").mapInPandas(run, "path string, content_hash string")


def split(files: DataFrame, n: int, at: int) -> DataFrame:
    """A share of the files, by a hash of their paths."""
    return files.filter(F.pmod(F.xxhash64("path"), F.lit(n)) == at)
