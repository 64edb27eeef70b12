"""Vector search, file means and semantic edges on array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..conf import CONF


#: Queries that are sent to the tasks at once; more go in further rounds. Queries times vectors of one matrix product.
ROUND, TILE = 20_000, 1 << 21
#: Scores are rounded to 6 digits: so far below a score another may lie that ties with it.
NEAR = 1.1e-6


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


class Nearest:
    """The k best rows of each query so far, ties by id.

    A matrix product says which rows may reach a query's k-th score; only these are scored, by the same sum for (a, b) as for (b, a)."""

    def __init__(self, q: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = q, k, metric
        self.norm = np.einsum("ij,ij->i", q, q)
        self.left = (q / np.maximum(np.sqrt(self.norm), 1e-12)[:, None] if metric == "cosine" else np.column_stack((q, np.ones(len(q))))).astype(np.float32)
        self.slack = 1.2e-7 * (self.left.shape[1] + 4)  # products are in single precision
        self.least = np.full(len(q), -np.inf)
        self.rows, self.n = [], 0

    def _limit(self, score: np.ndarray, on: np.ndarray, most: float) -> np.ndarray:
        """What the product must reach for a score that may round to `score`."""
        if self.metric == "cosine":
            return score - NEAR - self.slack
        low = score - NEAR
        far = np.where(low > 0, 1 / np.maximum(low, 1e-300) - 1, np.inf)
        return (self.norm[on] - far) / 2 - self.slack * (1 + self.norm[on] + most)

    def _exact(self, i: np.ndarray, v: np.ndarray, norm: np.ndarray) -> np.ndarray:
        s = np.einsum("ij,ij->i", self.q[i], v)
        if self.metric == "cosine":
            s /= np.maximum(np.sqrt(self.norm[i]) * np.sqrt(norm), 1e-12)
        else:
            s = 1 / (1 + np.maximum(self.norm[i] + norm - 2 * s, 0.0))
        return np.round(s, 6)

    def put(self, ids: np.ndarray, v: np.ndarray, on: np.ndarray | None = None) -> None:
        """Rows for the queries `on`, or for all."""
        on = np.arange(len(self.q)) if on is None else on
        if not len(on) or not len(ids):
            return
        left, step = (self.left if len(on) == len(self.q) else self.left[on]), max(1, TILE // len(on))
        for a in range(0, len(ids), step):
            part, of = v[a : a + step], ids[a : a + step]
            norm = np.einsum("ij,ij->i", part, part)
            small = np.sqrt(norm[norm > 0].min(initial=1)) * np.sqrt(self.norm[on][self.norm[on] > 0].min(initial=1)) < 1e-12
            if small or not (norm.max() < 1e30 and self.norm[on].max() < 1e30):
                may = np.ones((len(on), len(of)), bool)
            else:
                most = float(norm.max())
                right = part / np.maximum(np.sqrt(norm), 1e-12)[:, None] if self.metric == "cosine" else np.column_stack((part, -norm / 2))
                p = left @ right.astype(np.float32).T
                may = p >= self._limit(self.least[on], on, most).astype(np.float32)[:, None]
                if len(of) > self.k and np.count_nonzero(may) > 4 * self.k * len(on):
                    # the k-th of these rows is a limit, too
                    edge = np.partition(p, len(of) - self.k, axis=1)[:, -self.k].astype(np.float64) - self.slack * (1 if self.metric == "cosine" else 1 + self.norm[on] + most)
                    edge = edge if self.metric == "cosine" else 1 / (1 + np.maximum(self.norm[on] - 2 * edge, 0.0))
                    may &= p >= self._limit(edge, on, most).astype(np.float32)[:, None]
            i, j = np.divmod(np.flatnonzero(may), len(of))
            if not len(i):
                continue
            i = on[i]
            s = np.concatenate([self._exact(i[b : b + TILE // 8], part[j[b : b + TILE // 8]], norm[j[b : b + TILE // 8]]) for b in range(0, len(i), TILE // 8)])
            keep = np.isfinite(s) & (s >= self.least[i])
            self.rows.append((i[keep], of[j[keep]], s[keep]))
            self.n += int(keep.sum())
            if self.n > 2 * self.k * len(self.q) + TILE // 16:
                self.best()

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the k best of each query."""
        if not self.rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        i, ids, s = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        o = np.lexsort((ids, -s, i))
        i, ids, s = i[o], ids[o], s[o]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        full, keep = nth == self.k - 1, nth < self.k
        self.least[i[full]] = s[full]
        self.rows, self.n = [(i[keep], ids[keep], s[keep])], int(keep.sum())
        return self.rows[0]


def matrix(column) -> np.ndarray:
    """Rows of a list column as doubles."""
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = x.flatten()
    if len(x) and not flat.null_count and len(flat) % len(x) == 0 and len(pa.compute.unique(pa.compute.list_value_length(x))) == 1:
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    return np.array(x.to_pylist(), np.float64)


def rounds_of(queries: DataFrame, n: int, *more: str):
    """queries (query_id, q and more) without null ids and vectors, in rounds of about n rows: (ids, matrix, table) of each."""
    q = queries.select("query_id", "q", *more).filter("query_id is not null and q is not null")
    rounds = max(1, -(-q.count() // n))
    for r in range(rounds):
        rows = (q.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r) if rounds > 1 else q).toArrow()
        if len(rows):
            yield rows["query_id"].to_numpy().astype(np.int64), matrix(rows["q"]), rows


def _valid(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    b = b.filter(pa.compute.and_(b.column("id").is_valid(), b.column("v").is_valid()))
    return b, b.column("id").to_numpy(zero_copy_only=False), matrix(b.column("v")) if b.num_rows else np.zeros((0, 0))


def _nearest(sent, k: int, metric: str, same_folder: bool):
    """A task's k best for each query: products tile by tile, rows that reach a query's k-th score so far are merged."""

    def run(batches):
        qid, q, qf = sent.value
        near = Nearest(q, k, metric)
        for b in batches:
            b, ids, v = _valid(b)
            if same_folder:
                folder = np.array(b.column("folder").to_pylist(), object)
                for f in dict.fromkeys(folder.tolist()):
                    at = np.flatnonzero(folder == f)
                    near.put(ids[at], v[at], np.flatnonzero(qf == f))
            else:
                near.put(ids, v)
        i, ids, s = near.best()
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids), pa.array(s)], names=["query_id", "id", "score"])

    return run


def _together(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    out = parts[0] if parts else spark.createDataFrame([], schema)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2", same_folder: bool = False) -> DataFrame:
    """(query_id, id, score, rank), exact: tasks keep k rows a query, then k of all; ties by id.

    queries (query_id, q [, folder]) go in rounds of about ROUND, each sent to every task; vectors (id, v [, folder]). Null
    ids and null vectors are left out on both sides; of several queries with one id each finds its rows; equal ids are found each.
    """
    found, schema = [], "query_id long, id long, score double"
    for qid, m, rows in rounds_of(queries, ROUND, *(["folder"] if same_folder else [])):
        sent = vectors.sparkSession.sparkContext.broadcast((qid, m, np.array(rows["folder"].to_pylist(), object) if same_folder else None))
        found.append(vectors.mapInArrow(_nearest(sent, k, metric, same_folder), schema))
    from .lexical import top

    return top(_together(found, vectors.sparkSession, schema), ["query_id"], [F.desc("score"), F.asc("id")], k)


def _nearest_in_each(sent, k: int):
    """A task's k best for each query and folder: a folder's rows meet all queries in one product."""

    def run(batches):
        qid, q = sent.value
        best: dict = {}
        for b in batches:
            b, ids, v = _valid(b)
            folders = np.array(b.column("folder").to_pylist(), object)
            for f in dict.fromkeys(folders.tolist()):
                at = np.flatnonzero(folders == f)
                if f not in best:
                    best[f] = Nearest(q, k, "l2")
                best[f].put(ids[at], v[at])
        for f, near in best.items():
            i, ids, s = near.best()
            yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array([f] * len(i), pa.string()), pa.array(ids), pa.array(s)], names=["query_id", "folder", "id", "score"])

    return run


def knn_in_each(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, folder, id, score, rank): the k nearest of each query in each folder of vectors (id, v, folder), exact, by l2. A folder is one of few; queries go in rounds."""
    from .lexical import top

    found, schema = [], "query_id long, folder string, id long, score double"
    for qid, m, _ in rounds_of(queries, ROUND):
        sent = vectors.sparkSession.sparkContext.broadcast((qid, m))
        found.append(vectors.select("id", "v", "folder").mapInArrow(_nearest_in_each(sent, k), schema))
    return top(_together(found, vectors.sparkSession, schema), ["query_id", "folder"], [F.desc("score"), F.asc("id")], k)


def file_means(vectors: DataFrame, file: str) -> DataFrame:
    """(file, vec): L2-normalised mean of a file's vectors."""
    each = vectors.select(file, F.posexplode("v").alias("pos", "x")).groupBy(file, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    n = each.groupBy(file).agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("a")).select(file, F.transform("a", lambda s: s["m"]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return n.withColumn("norm", norm).select(file, F.transform("m", lambda x: F.round(x / F.greatest(F.col("norm"), F.lit(1e-12)), 6)).alias("vec"))


def semantic_edges(nodes: DataFrame, threshold: float = CONF.semantic_threshold, per_node: int = CONF.semantic_per_node) -> DataFrame:
    """(source, target, similarity): for each node the nearest others by cosine, as undirected edges."""
    q = nodes.select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    near = knn(q, nodes, per_node + 1, "cosine").filter("query_id <> id and score >= " + str(threshold))
    from .lexical import top

    near = top(near.drop("rank"), ["query_id"], [F.desc("score"), F.asc("id")], per_node)
    return near.select(F.least("query_id", "id").alias("source"), F.greatest("query_id", "id").alias("target"), F.col("score").alias("similarity")).distinct()
