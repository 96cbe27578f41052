"""Pages and events as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import HEAD_CHARS
from ..operators.groups import Batcher
from .play import millis


class OrderedGroups(StatefulProcessor):
    """Pages in any order of arrival become groups in page order.

    A document's waiting pages are kept by number. The longest run from the next expected page goes on;
    a group is held until a later page with text is known, whose beginning it carries as head. A row whose
    text is null and whose page is one past the last ends the document: missing pages count as blank. A page
    that came before, or lies past the end, gives a row with an error.
    """

    def __init__(self, n: int, most: int):
        self.n, self.most = n, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "page int", "text string")
        self.cursor = handle.getValueState("cursor", "next int, total int, group int")
        self.open = handle.getListState("open", "page int, block string")
        self.held = handle.getValueState("held", "group int, pages array<int>, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        doc, out = key[0], []
        at, total, group = self.cursor.get() if self.cursor.exists() else (1, 0, 0)
        batcher = Batcher(self.n, self.most)
        for page, block in self.open.get() if self.open.exists() else ():
            batcher.pages.append(page)
            batcher.parts.append(block)
            batcher.size += len(block)
        waiting = self.held.get() if self.held.exists() else None

        def emit(head=None):
            nonlocal waiting
            if waiting is not None:
                g, pages, text = waiting
                out.append((doc, g, list(pages), text, head, None))
                waiting = None

        def hold(batches):
            nonlocal waiting, group
            for pages, text in batches:
                emit(text[:HEAD_CHARS])
                waiting = (group, pages, text)
                group += 1

        for frame in rows:
            for page, text in zip(frame["page"].tolist(), frame["text"].tolist()):
                if text is None:
                    total = page - 1
                elif page < at or self.slots.containsKey((page,)) or (total and page > total):
                    out.append((doc, None, [page], None, None, "page out of range" if total and page > total else "page came twice"))
                else:
                    self.slots.updateValue((page,), (text,))
        while self.slots.containsKey((at,)) or (total and at <= total):
            text = self.slots.getValue((at,))[0] if self.slots.containsKey((at,)) else ""
            if self.slots.containsKey((at,)):
                self.slots.removeKey((at,))
            if text.strip():
                emit(text[:HEAD_CHARS])
                hold(batcher.add(at, f"--- page {at} ---\n{text}\n"))
            at += 1
        if total and at > total:
            hold(batcher.rest())
            emit()
            for state in (self.cursor, self.open, self.held, self.slots):
                state.clear()
        else:
            self.cursor.update((at, total, group))
            self.open.put(list(zip(batcher.pages, batcher.parts))) if batcher.pages else self.open.clear()
            self.held.update((waiting[0], list(waiting[1]), waiting[2])) if waiting is not None else self.held.clear()
        yield pd.DataFrame(out, columns=["doc_id", "group_no", "pages", "text", "head", "error"]).astype({"group_no": "Int32"})

    def close(self) -> None:
        pass


class SealedGroups(OrderedGroups):
    """OrderedGroups of documents that need no end: one that has been quiet for idle_ms is sealed.

    A timer goes off once the watermark is idle_ms past the document's last page. Then missing pages count as
    blank and the rest goes out. A page that comes later gives a row with an error, until keep_ms after the
    seal nothing of the document is left in state.
    """

    def __init__(self, n: int, most: int, idle_ms: int, keep_ms: int):
        super().__init__(n, most)
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.seal = handle.getValueState("seal", "due long, sealed boolean")

    def _due(self, at: int, sealed: bool, before: int | None) -> None:
        if before is not None and before != at:
            self.handle.deleteTimer(before)
        self.seal.update((at, sealed))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frames = list(rows)  # what one batch has of one document
        due, sealed = self.seal.get() if self.seal.exists() else (None, False)
        if sealed:
            late = [p for f in frames for p in f["page"].tolist()]
            yield pd.DataFrame([(key[0], None, [p], None, None, "document is sealed") for p in late], columns=["doc_id", "group_no", "pages", "text", "head", "error"]).astype({"group_no": "Int32"})
            return
        yield from super().handleInputRows(key, iter(frames), timerValues)
        last = max(max(millis(f["at"])) for f in frames)
        if self.cursor.exists():
            self._due(max(last + self.idle_ms, due or 0), False, due)
        else:  # its end came as a row
            self._due(last + self.keep_ms, True, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        due, sealed = self.seal.get() if self.seal.exists() else (None, True)
        if due != now:
            return
        if sealed:
            self.seal.clear()
            return
        last = max([self.cursor.get()[0] - 1, *(k[0] for k in self.slots.keys())])
        if last:
            yield from super().handleInputRows(key, iter([pd.DataFrame({"page": [last + 1], "text": [None]})]), timerValues)
        else:
            self.cursor.clear()
        self._due(now + self.keep_ms, True, None)


def sealed_groups(pages: DataFrame, n: int, most: int, idle_ms: int, keep_ms: int, delay: str = "10 minutes") -> DataFrame:
    """ordered_groups() of a stream of (doc_id, page, text, at) in which documents end by time; see SealedGroups."""
    p = pages.select("doc_id", F.col("page").cast("int").alias("page"), "text", "at").withWatermark("at", delay)
    return p.groupBy("doc_id").transformWithStateInPandas(
        SealedGroups(n, most, idle_ms, keep_ms), outputStructType="doc_id long, group_no int, pages array<int>, text string, head string, error string", outputMode="Append", timeMode="EventTime"
    )


def ordered_groups(pages: DataFrame, n: int, most: int) -> DataFrame:
    """Stream of (doc_id, group_no, pages, text, head, error) from a stream of (doc_id, page, text)."""
    p = pages.select("doc_id", F.col("page").cast("int").alias("page"), "text")
    return p.groupBy("doc_id").transformWithStateInPandas(
        OrderedGroups(n, most), outputStructType="doc_id long, group_no int, pages array<int>, text string, head string, error string", outputMode="Append", timeMode="None"
    )


def first_commits(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Stream of each page's first commit; later ones within the delay are dropped."""
    return events.filter("kind = 'commit'").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job", "page"])


def rates(events: DataFrame, width: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Stream of commits by node and window of event time."""
    e = events.filter("kind = 'commit'").withWatermark("ts", delay)
    return e.groupBy(F.window("ts", width), "node").agg(F.count("*").alias("pages")).select(F.col("window.start").alias("start"), "node", "pages")
