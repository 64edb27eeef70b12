"""Which keys occur more than once, for rows (key, id, pos) made by a Python mapper.

Each map task first meets its own repeats: of the rows of one key that it holds, all are settled at once and only one
goes to the shuffle under that key. So a key that a third of all rows share sends a row per map task, not a row
per occurrence, and no reducer gathers it whole. Occurrences equal in (id, pos) count once. A mapper may give a second half of
the key; then keys are equal if both halves are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

#: Rows of a map task that are compared before they go out; bounds its memory.
BUFFER = 1 << 18
SCHEMA = pa.schema([("route", pa.int64()), ("key", pa.int64()), ("id", pa.int64()), ("pos", pa.int64()), ("more", pa.int64()), ("state", pa.int8())])
SPARK = "route long, key long, id long, pos long, more long, state byte"
#: state: alone in its task; known to repeat, stands for its key; settled, only passes through.
ALONE, KNOWN, SETTLED = 0, 1, 2


def _runs(key: np.ndarray, ident: np.ndarray, pos: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key without repeated (key, id, pos), and the start of each key's run in it."""
    order = np.lexsort((pos, ident, more, key) if more.any() else (pos, ident, key))
    k, m, i, p = key[order], more[order], ident[order], pos[order]
    new = np.ones(len(k), bool)
    other = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    new[1:] = other | (i[1:] != i[:-1]) | (p[1:] != p[:-1])
    order = order[new]
    first = np.ones(len(order), bool)
    first[1:] = (key[order[1:]] != key[order[:-1]]) | (more[order[1:]] != more[order[:-1]])
    return order, np.flatnonzero(first)


def combined(key: np.ndarray, ident: np.ndarray, pos: np.ndarray, more: np.ndarray | None = None) -> pa.RecordBatch:
    more = np.zeros(len(key), np.int64) if more is None else more
    order, start = _runs(key, ident, pos, more)
    size = np.diff(np.append(start, len(order)))
    many = np.repeat(size > 1, size)
    state = np.where(many, SETTLED, ALONE).astype(np.int8)
    state[start[size > 1]] = KNOWN
    k = key[order].view(np.int64)
    # settled rows go anywhere: by their place in the task, so that no reducer gets more than its share
    route = np.where(state == SETTLED, np.arange(len(k), dtype=np.int64) * 0x9E3779B1 + 1, k)
    return pa.RecordBatch.from_arrays([pa.array(route), pa.array(k), pa.array(ident[order].view(np.int64)), pa.array(pos[order].astype(np.int64)), pa.array(more[order]), pa.array(state)], schema=SCHEMA)


def mapper(rows: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]):
    """A function for mapInArrow out of one that yields arrays (key, id, pos) or (key, id, pos, second half) for a batch."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            for x in rows(b):
                held.append(x)
                n += len(x[0])
                if n >= BUFFER:
                    yield combined(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, n = [], 0
        if held:
            yield combined(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _reduce(batches):
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    key, ident, pos, more, state = (t.column(c).to_numpy() for c in ("key", "id", "pos", "more", "state"))
    out = np.flatnonzero(state == SETTLED)
    rest = np.flatnonzero(state != SETTLED)
    order, start = _runs(key[rest], ident[rest], pos[rest], more[rest])
    order = rest[order]
    if len(order):
        size = np.diff(np.append(start, len(order)))
        known = np.maximum.reduceat(state[order], start) == KNOWN
        out = np.concatenate((out, order[np.repeat((size > 1) | known, size)]))
    for a in range(0, len(out), 1 << 16):
        o = out[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(key[o]), pa.array(ident[o]), pa.array(pos[o])], names=["key", "id", "pos"])


def repeated(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], partitions: int) -> DataFrame:
    """(key, id, pos) of the rows whose key is also that of another (id, pos)."""
    return df.mapInArrow(lean(mapper(rows)), SPARK).repartition(partitions, "route").mapInArrow(lean(_reduce), "key long, id long, pos long")
