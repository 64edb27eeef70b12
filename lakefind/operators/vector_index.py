"""Inverted-file index over vectors: cells of k-means, rows stored by cell, searches that read a few cells.

Centres are trained on a bounded sample; every row is then given to its nearest centre and written under it, so a search that probes some cells
reads their folders only. Rows are scored exactly, by the same formula as `vector.knn`; with all cells probed the result is the same. How many cells
are enough is measured when the index is built: the least number that gives the wanted recall for a sample of the rows themselves.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import CONF
from . import lexical, vector

#: Rows that centres are trained on; cells at most (every task holds the centres); rounds of training; rows that the number of probes is measured with, and against how many.
SAMPLE, CELLS, STEPS, ASKED, AGAINST = 32_768, 4096, 12, 256, 16_384
#: Queries sent to the tasks at once; of them and of rows, so many at once in a task where queries probe some cells only.
ROUND, BLOCK, GROUP = 20_000, 4096, 4096


def _unit(v: np.ndarray, metric: str) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) if metric == "cosine" else v


def _nearest_cells(v: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of each row, the nearest first."""
    d = (centres**2).sum(1) - 2 * v @ centres.T
    if n >= len(centres):
        return np.argsort(d, axis=1, kind="stable")
    near = np.argpartition(d, n - 1, axis=1)[:, :n]
    return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)


def trained(v: np.ndarray, cells: int) -> np.ndarray:
    """Centres by Lloyd's steps; a centre without rows takes the row that is farthest from its own."""
    r = np.random.default_rng(7)
    centres = v[r.choice(len(v), min(cells, len(v)), replace=False)]
    for _ in range(STEPS):
        own = _nearest_cells(v, centres, 1)[:, 0]
        far = ((v - centres[own]) ** 2).sum(1)
        order, start = np.argsort(own, kind="stable"), np.searchsorted(np.sort(own), np.arange(len(centres)))
        size = np.bincount(own, minlength=len(centres))
        some = size > 0
        centres = centres.copy()
        centres[some] = np.add.reduceat(v[order], start[some], axis=0) / size[some, None]
        if (~some).any():
            centres[~some] = v[np.argsort(-far)[: int((~some).sum())]]
    return centres


def scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    s = q @ v.T
    if metric == "cosine":
        s /= np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None], 1e-12)
    else:
        s = 1 / (1 + np.maximum((q**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * s, 0.0))
    return np.round(s, 6)


class VectorIndex:
    """Folders: cells (cell, centre), rows/cell=n (id, v), about (one line of json)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, metric: str = "l2", recall: float = 0.95, k: int = 10, cells: int | None = None) -> dict:
        """vectors (id long, v) -> what the index says of itself. Rows of null id or vector are left out."""
        v = vectors.filter("id is not null and v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
        n = v.count()
        sample = v.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        x = _unit(np.array([r.v for r in sample], np.float64).reshape(len(sample), len(sample[0].v) if sample else 0), metric)
        cells = cells or int(min(CELLS, max(1, np.sqrt(n))))
        centres = trained(x, cells) if n else np.zeros((0, 0))
        sent = self.spark.sparkContext.broadcast(centres)

        def run(batches):
            for b in batches:
                rows = _unit(np.array(b.column("v").to_pylist(), np.float64).reshape(b.num_rows, -1), metric)
                cell = _nearest_cells(rows, sent.value, 1)[:, 0] if b.num_rows else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32))], names=["id", "v", "cell"])

        # rows of a cell lie together, those of a large one in several files
        put = v.mapInArrow(run, "id long, v array<double>, cell int").repartitionByRange(F.col("cell"), F.xxhash64("id"))
        put.write.mode("overwrite").partitionBy("cell").parquet(f"{self.root}/rows")
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{self.root}/cells")
        probes, got = self._measured(x, centres, metric, recall, k)
        about = {"metric": metric, "cells": len(centres), "rows": n, "probes": probes, "recall": got}
        self.spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/about")
        return about

    @staticmethod
    def _measured(x: np.ndarray, centres: np.ndarray, metric: str, recall: float, k: int) -> tuple[int, float]:
        """(probes, recall): how many cells a row of the sample must probe to find `recall` of its k nearest in it."""
        if len(x) < 2:
            return max(1, len(centres)), 1.0
        asked, rows = x[:ASKED], x[:AGAINST]
        own = _nearest_cells(rows, centres, 1)[:, 0]
        place = np.argsort(_nearest_cells(asked, centres, len(centres)), axis=1)  # of each cell in a query's order
        s = scores(asked, rows, metric)
        s[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        near = np.argsort(-s, axis=1, kind="stable")[:, : min(k, len(rows) - 1)]
        at = np.sort(np.take_along_axis(place, own[near], 1).ravel())
        probes = int(at[max(0, int(np.ceil(recall * len(at))) - 1)]) + 1
        return probes, float((at < probes).mean())

    def about(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/about").first().value)

    def _centres(self) -> np.ndarray:
        return np.array([r.centre for r in self.spark.read.parquet(f"{self.root}/cells").orderBy("cell").collect()], np.float64)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """(id, v, cell): of some cells only their folders are read."""
        d = self.spark.read.schema("id long, v array<double>, cell int").parquet(f"{self.root}/rows")
        return d if cells is None else d.filter(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """queries (query_id, q) -> (query_id, id, score, rank). probes: cells a query looks into; without one as many as were measured."""
        about, centres = self.about(), self._centres()
        found = self.spark.createDataFrame([], "query_id long, id long, score double")
        if len(centres):
            for qid, q, _ in vector.rounds_of(queries, ROUND):
                found = found.unionByName(self._found(qid, q, centres, k, probes or about["probes"], about["metric"]))
        return lexical.top(found, ["query_id"], [F.desc("score"), F.asc("id")], k)

    def _found(self, qid: np.ndarray, q: np.ndarray, centres: np.ndarray, k: int, probes: int, metric: str) -> DataFrame:
        by_cell = None
        if probes < len(centres):
            near = _nearest_cells(_unit(q, metric), centres, probes).ravel()
            order = np.argsort(near, kind="stable")
            cell, start = np.unique(near[order], return_index=True)
            by_cell = {int(c): np.sort(o // probes) for c, o in zip(cell, np.split(order, start[1:]), strict=True)}
        sent = self.spark.sparkContext.broadcast((qid, q, by_cell))

        def run(batches):
            qid, q, by_cell = sent.value
            near = vector.Nearest(q, k, metric)
            for b in batches:
                ids, v = b.column("id").to_numpy(), vector.matrix(b.column("v"))
                if by_cell is None:
                    near.put(ids, v)
                    continue
                cell = b.column("cell").to_numpy()
                for c in np.unique(cell):
                    if (on := by_cell.get(int(c))) is not None:
                        at = np.flatnonzero(cell == c)
                        for a in range(0, len(at), BLOCK):
                            for g in range(0, len(on), GROUP):
                                near.put(ids[at[a : a + BLOCK]], v[at[a : a + BLOCK]], on[g : g + GROUP])
            i, ids, s = near.best()
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(ids), pa.array(s)], names=["query_id", "id", "score"])

        return self.rows(by_cell and sorted(by_cell)).mapInArrow(run, "query_id long, id long, score double")

    def neighbours(self, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, id, score, rank): every row of the index as a query, in rounds. A task holds k rows a query of a round, whatever cells it reads."""
        rows = self.rows().select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        near = self.search(rows, k + 1, probes).filter("query_id <> id").drop("rank")
        return lexical.top(near, ["query_id"], [F.desc("score"), F.asc("id")], k)


def semantic_edges(index: VectorIndex, threshold: float = CONF.semantic_threshold, per_node: int = CONF.semantic_per_node, probes: int | None = None) -> DataFrame:
    """(source, target, similarity): for each row of a cosine index its nearest others, as undirected edges."""
    near = index.neighbours(per_node, probes).filter(F.col("score") >= threshold)
    return near.select(F.least("query_id", "id").alias("source"), F.greatest("query_id", "id").alias("target"), F.col("score").alias("similarity")).distinct()
