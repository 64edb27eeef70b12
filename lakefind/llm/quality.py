"""Regularised quadratic discriminant for document quality.

Each class is a normal density over transformed statistics of the text. Class covariances shrink towards the pooled one and
towards its diagonal; their Cholesky factors are made once. The score is the logistic of the difference of the log
densities (Mahalanobis distances and determinants) and the log prior odds.

Labels are learnt from all labelled rows outside the fold that is held out: the model is made of sums over rows, each a pass over their
statistics, of which tasks give partial sums. Texts are whole. Defined results: null and
empty texts have all statistics zero and get a score like any other. One class or no labels: score 1 or 0 for that class, 0.5
without labels. Rows with equal or null ids are scored each; a label row of a null id is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, slices, staged, table
from .labelled import fold, labelled

SHRINK_POOLED, SHRINK_DIAGONAL = 0.2, 0.1
_IS = {k: np.zeros(256, bool) for k in ("lower", "upper", "digit", "space", "punct", "symbol", "high")}
_IS["lower"][97:123] = _IS["upper"][65:91] = _IS["digit"][48:58] = _IS["high"][128:] = True
_IS["space"][[32, *range(9, 14)]] = True
_IS["punct"][[ord(x) for x in ".,;:!?'\"()-"]] = True
_IS["symbol"][33:127] = ~(_IS["lower"] | _IS["upper"] | _IS["digit"] | _IS["punct"])[33:127]
_MASKS = np.array(list(_IS.values())).T.astype(np.float64)


def statistics(text: str) -> list[float]:
    """Transformed statistics: log sizes and square roots of shares."""
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * 19
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = hist @ _MASKS / n
    p = hist[hist > 0] / n
    words = raw.split()
    k = max(len(words), 1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    distinct = set(words)
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    return [
        np.log1p(n), np.log1p(k), np.log1p(m), *np.sqrt(shares), float(-(p * np.log(p)).sum()),
        np.log(lengths.mean() + 1), np.log(lengths.std() + 1), len(distinct) / k / (k**-0.15), len(set(lines)) / m,
        np.log1p(k / m), np.sqrt(sum(not x.endswith((b".", b"!", b"?")) for x in lines) / m), np.sqrt((raw.count(b"!") + raw.count(b"|")) / k), len(zlib.compress(raw, 1)) / (n + 20),
    ]


class Quadratic:
    """total(f): the sum of f(x, y) over all blocks of rows; None without rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.fit(lambda f: f(x, y) if len(y) else None)

    @classmethod
    def of(cls, total: Callable) -> Quadratic:
        out = cls.__new__(cls)
        out.fit(total)
        return out

    def fit(self, total: Callable) -> None:
        first = total(lambda x, y: np.concatenate(([(y == 0).sum(), (y == 1).sum()], x.sum(0))))
        n = np.zeros(2) if first is None else first[:2]
        self.only = None if n.all() else 0.5 if not n.any() else float(n[1] > 0)
        if self.only is not None:
            return
        self.at = at = first[2:] / n.sum()
        self.scale = scale = np.sqrt(total(lambda x, y: ((x - at) ** 2).sum(0)) / n.sum()) + 1e-6

        def moments(x, y):
            z = np.clip((x - at) / scale, -6, 6)
            return np.concatenate([np.concatenate((z[y == c].sum(0), (z[y == c].T @ z[y == c]).ravel())) for c in (0, 1)])

        k = len(at)
        of = total(moments).reshape(2, k + k * k)
        mean = [of[c, :k] / n[c] for c in (0, 1)]
        cov = [(of[c, k:].reshape(k, k) - n[c] * np.outer(mean[c], mean[c])) / (n[c] - 1) if n[c] > 1 else np.eye(k) for c in (0, 1)]
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        self.mean, self.factor, self.half_log_det = [], [], []
        for c in (0, 1):
            # few rows lean more on the pooled covariance
            w = SHRINK_POOLED + (1 - SHRINK_POOLED) * k / (k + n[c])
            s = (1 - w) * cov[c] + w * pooled
            s = (1 - SHRINK_DIAGONAL) * s + SHRINK_DIAGONAL * np.diag(np.diag(s)) + 1e-3 * np.eye(k)
            factor = np.linalg.cholesky(s)
            self.mean.append(mean[c])
            self.factor.append(np.linalg.inv(factor))
            self.half_log_det.append(float(np.log(np.diag(factor)).sum()))
        self.log_odds = float(np.log(n[1] / n[0]))
        # densities of many dependent statistics are too sure: one slope for the difference, fitted to the same rows
        grid = np.geomspace(0.02, 1, 25)

        def loss(x, y):
            d = self.difference(x) + self.log_odds
            return np.array([np.logaddexp(0, -(2 * y - 1) * g * d).sum() for g in grid])

        self.slope = float(grid[int(np.argmin(total(loss)))])

    def difference(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.at) / self.scale, -6, 6)
        log = [-0.5 * (((z - m) @ f.T) ** 2).sum(1) - h for m, f, h in zip(self.mean, self.factor, self.half_log_det, strict=True)]
        return log[1] - log[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.difference(x) + self.log_odds), -30, 30)))


def scored(docs: DataFrame, model: Quadratic, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in (x for batch in batches for x in slices(batch)):
            x = np.array([statistics(t or "") for t in b.column("text").to_pylist()]).reshape(-1, 19)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sent.value.score(x), pa.float64())], names=["id", "score"])

    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return d.mapInArrow(lean(run), f"id {dict(d.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def over(rows: DataFrame) -> Callable:
    """total() of Quadratic over rows (x, y): a row from each task reaches the driver."""

    def total(f):
        def run(batches):
            out = None
            for b in batches:
                if b.num_rows:
                    x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    some = f(x, b.column("y").to_numpy(zero_copy_only=False))
                    out = some if out is None else out + some
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], names=["s"])

        # added in an order that doesn't depend on which task ends first
        found = sorted(r.s for r in rows.mapInArrow(lean(run), "s array<double>").collect())
        return np.sum(np.array(found), axis=0) if found else None

    return total


def learnt(docs: DataFrame, labels: DataFrame) -> Quadratic:
    def run(batches):
        for b in (x for batch in batches for x in slices(batch)):
            x = [statistics(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    rows = labelled(docs, labels, "quality", fold("doc_id", 3) != 1)
    return Quadratic.of(over(staged(rows.mapInArrow(lean(run), "x array<double>, y int"))))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = scored(docs, learnt(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
