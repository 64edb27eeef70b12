"""Progress with state and a timer for each key: values at most so often and the last one never lost; runs that have come to a halt.

Both keep what may still change their order until the watermark has passed it, so the result is that of the events in their own order, however they
came, and goes on after a restart from where it was. Events older than the watermark when they come are dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Milliseconds between two values that are passed on.
EVERY = 250


def sequence(events: Iterable[tuple[int, str]], last: int | None, waiting: str | None, until: int, every: int) -> tuple[list[tuple[int, str]], int | None, str | None]:
    """What is passed on of (time, value) in order up to a time: a value at once if the one before is `every` old, else the newest one when it is."""
    out = []
    for at, value in [*events, (None, None)]:
        due = None if waiting is None else last + every
        if due is not None and due <= (until if at is None else at):
            out.append((due, waiting))
            last, waiting = due, None
        if at is None:
            break
        if last is None or at - last >= every:
            out.append((at, value))
            last, waiting = at, None
        else:
            waiting = value
    return out, last, waiting


def throttled(events: DataFrame, by: str, time: str = "ts", value: str = "state", every: int = EVERY, late: str = "10 seconds") -> DataFrame:
    """A stream of events -> (by, at, value): for each key the values that are passed on, and when (to the millisecond)."""

    def run(key, batches: Iterator[pd.DataFrame], state):
        held, last, waiting = state.get if state.exists else ([], None, None)
        held = [tuple(x) for x in held]
        now = state.getCurrentWatermarkMs()
        for b in batches:
            held += [(int(t), v) for t, v in zip(b["__ms"], b["__v"], strict=True) if int(t) > now]
        held.sort()
        ready = [x for x in held if x[0] <= now]
        held = held[len(ready) :]
        out, last, waiting = sequence(ready, last, waiting, now, every)
        state.update(([list(x) for x in held], last, waiting))
        due = min([x[0] for x in held[:1]] + ([last + every] if waiting is not None else []), default=None)
        if due is not None:
            state.setTimeoutTimestamp(max(due, now + 1))
        elif last is not None and last + every <= now:
            state.remove()  # the next value is passed on at once, as the first one is
        if out:
            yield pd.DataFrame({"k": key[0], "ms": [a for a, _ in out], "v": [v for _, v in out]})

    e = events.withWatermark(time, late).select(F.col(by).alias("__k"), F.unix_millis(time).alias("__ms"), F.col(value).cast("string").alias("__v"), time)
    kind = dict(events.dtypes)[by]
    shape = "held array<struct<a:long,v:string>>, last long, waiting string"
    made = e.groupBy("__k").applyInPandasWithState(run, f"k {kind}, ms long, v string", shape, "append", "EventTimeTimeout")
    return made.select(F.col("k").alias(by), F.timestamp_millis("ms").alias("at"), F.col("v").alias(value))


def halted(events: DataFrame, by: str = "run_id", time: str = "ts", done: str = "done", ended: str = "ended", after: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """A stream of events (by, time, done: how far the run is, ended: whether it has) -> (by, since, at): runs whose `done` hasn't grown for `after` ms.

    The timer fires without a new event of the run; a run that goes on may come to a halt again.
    """

    def run(key, batches: Iterator[pd.DataFrame], state):
        held, grown, best, said = state.get if state.exists else ([], None, None, False)
        held = [tuple(x) for x in held]
        now = state.getCurrentWatermarkMs()
        for b in batches:
            held += [(int(t), int(d), bool(x)) for t, d, x in zip(b["__ms"], b["__d"], b["__e"], strict=True) if int(t) > now]
        held.sort()
        ready, held = [x for x in held if x[0] <= now], [x for x in held if x[0] > now]
        out = []
        over = False
        for at, far, end in [*ready, (now, None, False)]:
            if grown is not None and not said and at - grown >= after:
                out.append((grown, grown + after))
                said = True
            if end:
                over = True
                break
            if far is not None and (best is None or far > best):
                grown, best, said = at, far, False
        if over:
            state.remove()
        else:
            state.update(([list(x) for x in held], grown, best, said))
            due = min([x[0] for x in held[:1]] + ([grown + after] if grown is not None and not said else []), default=None)
            if due is not None:
                state.setTimeoutTimestamp(max(due, now + 1))
        if out:
            yield pd.DataFrame({"k": key[0], "since": [a for a, _ in out], "at": [b for _, b in out]})

    e = events.withWatermark(time, late).select(F.col(by).alias("__k"), F.unix_millis(time).alias("__ms"), F.col(done).cast("long").alias("__d"), F.col(ended).alias("__e"), time)
    kind = dict(events.dtypes)[by]
    shape = "held array<struct<a:long,d:long,e:boolean>>, grown long, best long, said boolean"
    made = e.groupBy("__k").applyInPandasWithState(run, f"k {kind}, since long, at long", shape, "append", "EventTimeTimeout")
    return made.select(F.col("k").alias(by), F.timestamp_millis("since").alias("since"), F.timestamp_millis("at").alias("at"))
