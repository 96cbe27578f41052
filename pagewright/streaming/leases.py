"""Leases that run out, by timers of event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .play import millis

KEEP_MS = 86_400_000  # after its commit a page's claims are refused for so long


#: What is held of an event. Claims of no node are leases, but no commit is theirs.
EVENT = np.dtype([("at", "i8"), ("node", "i8"), ("known", "?"), ("claim", "?")])
ROWS = 100_000  # that a task hands on at once


def due(events: np.ndarray, lease_ms: int) -> np.ndarray:
    """When something follows from each event: a claim's deadline, or a commit's own time."""
    return np.where(events["claim"], events["at"] + lease_ms, events["at"])


def swept(events: np.ndarray, done: int | None, now: int, lease_ms: int, keep_ms: int) -> tuple[np.ndarray, int | None, np.ndarray]:
    """(deadlines up to now at which a page is queued again, its last commit that counts, events that still matter).

    events are all EVENTs of the page that matter, in any order, and done its last commit that counted before. All
    deadlines are told at once by sorted times, so that a page with many claims costs no more for each.
    """
    keep = max(keep_ms, lease_ms)  # a commit is known as long as its lease could be
    e = events[np.lexsort((~events["claim"], events["at"], events["node"], events["known"]))]
    claim, at = e["claim"], e["at"]
    place = np.maximum.accumulate(np.where(claim, np.arange(len(e)), -1))
    last = e[place]  # the node's last claim up to each event, if it is this node's
    held = ~claim & e["known"] & (place >= 0) & last["known"] & (last["node"] == e["node"]) & (at < last["at"] + lease_ms) & (at <= now)
    good, claims = np.sort(at[held]), np.unique(at[claim])
    count = [] if done is None else [done]
    while (k := np.searchsorted(good, count[-1] + keep - lease_ms, "right") if count else 0) < len(good):
        count.append(int(good[k]))
    ends = claims[claims + lease_ms <= now] + lease_ms
    ends = ends[claims[np.searchsorted(claims, ends, "right") - 1] + lease_ms <= ends]  # no lease is live
    if count:
        n = np.searchsorted(count, ends, "right") - 1
        ends = ends[(n < 0) | (np.array(count)[n] + keep < ends)]
    return ends, count[-1] if count and count[-1] + keep > now else None, e[due(e, lease_ms) > now]


class Requeues(StatefulProcessor):
    """Claims and commits of one page become its requeues.

    When the watermark has passed a claim's deadline, all that happened before is known, whatever the order in
    which it came: the page is queued again if no commit under a live lease of its node came before, and no
    other lease is live. A page has one timer, of the first moment that something follows from; then all up to the
    watermark is told at once. A committed page is remembered for KEEP_MS.
    """

    def __init__(self, lease_ms: int, keep_ms: int = KEEP_MS):
        self.lease_ms, self.keep_ms = lease_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "events binary")
        self.done = handle.getValueState("done", "at long")
        self.timer = handle.getValueState("timer", "at long")

    def _value(self, state) -> int | None:
        return state.get()[0] if state.exists() else None

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        blocks = [np.empty(0, EVENT)]
        for frame in rows:
            e = np.empty(len(frame), EVENT)
            e["at"], e["node"], e["known"], e["claim"] = millis(frame["ts"]), frame["node"], frame["known"], frame["claim"]
            blocks.append(e)
        e = np.concatenate(blocks)
        if len(e):
            self.held.appendValue((e.tobytes(),))  # once: appends are slow where much is held
            first, timer = int(due(e, self.lease_ms).min()), self._value(self.timer)
            if timer is None or first < timer:
                if timer is not None:
                    self.handle.deleteTimer(timer)
                self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        held = [np.frombuffer(x[0], EVENT) for x in self.held.get()] if self.held.exists() else []
        ends, done, left = swept(np.concatenate([np.empty(0, EVENT), *held]), self._value(self.done), now, self.lease_ms, self.keep_ms)
        self.held.put([(left.tobytes(),)]) if len(left) else self.held.clear()
        self.done.clear() if done is None else self.done.update((done,))
        then = [int(due(left, self.lease_ms).min())] if len(left) else []
        then += [] if done is None else [done + max(self.keep_ms, self.lease_ms)]
        self._wake(min(then)) if then else self.timer.clear()
        for k in range(0, len(ends), ROWS):
            yield pd.DataFrame({"job": key[0], "page": key[1], "at_ms": ends[k : k + ROWS]})

    def close(self) -> None:
        pass


def requeues(events: DataFrame, lease_ms: int, delay: str = "10 minutes", keep_ms: int = KEEP_MS) -> DataFrame:
    """Stream of (job, page, at_ms): when pages are queued again, from a stream of events (job, page, node, ts, kind).

    Kinds other than claim and commit don't count, nor do events without ts. Events that are late by more than delay
    are dropped; up to that their order doesn't matter. Jobs, pages and nodes are whole numbers; times count in ms.
    """
    e = events.filter("kind IN ('claim', 'commit') AND ts IS NOT NULL").select(
        F.col("job").cast("long").alias("job"), F.col("page").cast("int").alias("page"), F.coalesce(F.col("node").cast("long"), F.lit(0)).alias("node"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("node").cast("long").isNotNull().alias("known"), (F.col("kind") == "claim").alias("claim"),
    )
    return e.withWatermark("ts", delay).groupBy("job", "page").transformWithStateInPandas(
        Requeues(lease_ms, keep_ms), outputStructType="job long, page int, at_ms long", outputMode="Append", timeMode="EventTime"
    )


def admitted(pages: DataFrame, classes: DataFrame, wait: str, delay: str = "10 minutes") -> DataFrame:
    """pages (doc_id, page, at, ...) with use_layer once they are classified by classes (doc_id, page, at, use_layer).

    A classification counts up to wait after its page came; pages without any come out after that, with null.
    Both sides may be streams, with watermarks that let go of what can no longer meet, or both tables. Of
    several classifications of a page each gives a row.
    """
    c = classes.select(F.col("doc_id").alias("__doc"), F.col("page").alias("__page"), F.col("at").alias("__at"), "use_layer")
    p, c = pages.withWatermark("at", delay), c.withWatermark("__at", delay)
    met = F.expr(f"doc_id = __doc AND page = __page AND __at >= at AND __at <= at + INTERVAL {wait}")
    return p.join(c, met, "leftOuter").drop("__doc", "__page", "__at")
