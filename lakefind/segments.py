"""Tables in segments: each round writes what it made and which files it replaces; readers put them together.

A segment is a folder with a table of each kind and `gone`, the files (library_id, path) whose rows in older segments don't count any more. Which
segments there are, oldest first, is said by a log entry, so a reader sees one round's state whole. Segments of like size are merged, so
there are few of them; a merged one takes over the marks of those that it replaces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["library_id", "path"]
GONE = "library_id string, path string, record boolean"
#: A segment is merged with the newer one behind it while it has less than so many times its rows.
FACTOR = 2
#: Rows of marks that are sent to every task; more are joined by a shuffle.
SENT = 1_000_000


class Segments:
    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), schemas

    def new(self) -> str:
        return uuid.uuid4().hex

    def write(self, name: str, kind: str, rows: DataFrame, *by: str) -> DataFrame:
        """A table of a segment, in folders by some of its columns."""
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/{kind}")
        return self.one(name, kind)

    def one(self, name: str, kind: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[kind] if kind != "gone" else GONE).parquet(f"{self.root}/{name}/{kind}")

    def read(self, kind: str, segments: list[dict], records: bool = False) -> DataFrame:
        """The rows that count over segments ({"name", "gone"}: marks it has). records: marks of rows of which only the record was made anew count too."""
        out = None
        for k, s in enumerate(segments):
            rows = self.one(s["name"], kind)
            later = [x for x in segments[k + 1 :] if x["gone"]]
            if later:
                marks = None
                for x in later:
                    m = self.one(x["name"], "gone")
                    marks = m if marks is None else marks.unionByName(m)
                marks = (marks if records else marks.filter("not record")).select(*KEY)
                n = sum(x["gone"] for x in later)
                rows = rows.join(F.broadcast(marks) if n <= SENT else marks, KEY, "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schemas[kind]) if out is None else out

    def merged(self, segments: list[dict], buckets: dict[str, str], records: set[str]) -> list[dict]:
        """segments with the newest ones of like size put together; buckets: by which column a kind lies in folders; records: kinds of records."""
        out = list(segments)
        while len(out) > 1 and out[-2]["rows"] < FACTOR * max(1, out[-1]["rows"]):
            a, b = out[-2:]
            name = self.new()
            for kind in self.schemas:
                by = [buckets[kind]] if kind in buckets else []
                live = self.read(kind, [a, b], records=kind in records)
                self.write(name, kind, live.repartition(*by) if by else live, *by)
            marks = self.one(a["name"], "gone").unionByName(self.one(b["name"], "gone"))
            # a file made anew is gone, whatever else is said of it
            marks = self.write(name, "gone", marks.groupBy(*KEY).agg(F.min("record").alias("record")))
            out[-2:] = [{"name": name, "gone": marks.count(), "rows": self.one(name, "chunks").count() if "chunks" in self.schemas else 0}]
        return out

    def unused(self, kept: set[str], older_than_ms: int) -> list:
        """Folders of segments that no kept entry names and that haven't been written to since a time."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in kept and s.getModificationTime() < older_than_ms]
