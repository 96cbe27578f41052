"""Batches of pages for a prompt, and what follows them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import HEAD_CHARS, blank, page_block


def lookahead(pages: DataFrame, chars: int = HEAD_CHARS) -> DataFrame:
    """pages with head: the first characters of the document's next page that isn't blank, null without one."""
    # backwards, so that the frame only grows and a document costs its length, not its square
    later = W.partitionBy("doc_id").orderBy(F.desc("page")).rowsBetween(W.unboundedPreceding, -1)
    return pages.withColumn("head", F.last(F.when(~blank(F.col("text")), F.substring("text", 1, chars)), ignorenulls=True).over(later))


def fixed_groups(pages: DataFrame, n: int) -> DataFrame:
    """(doc_id, group_no, pages) of n pages that aren't blank, for when no group can be too long."""
    order = W.partitionBy("doc_id").orderBy("page")
    some = pages.filter(~blank(F.col("text"))).withColumn("group_no", F.floor((F.row_number().over(order) - 1) / n).cast("int"))
    return some.groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list("page")).alias("pages"))


class Batcher:
    """Closes a batch before the page that would make it longer than most characters, and at n pages."""

    def __init__(self, n: int, most: int):
        self.n, self.most, self.pages, self.parts, self.size = n, most, [], [], 0

    def add(self, page: int, block: str) -> Iterator[tuple[list[int], str]]:
        if self.pages and self.size + len(block) > self.most:
            yield self.take()
        if len(block) > self.most:
            yield [page], block[: self.most]
            return
        self.pages.append(page)
        self.parts.append(block)
        self.size += len(block)
        if len(self.pages) == self.n:
            yield self.take()

    def take(self) -> tuple[list[int], str]:
        out = self.pages, "".join(self.parts)
        self.pages, self.parts, self.size = [], [], 0
        return out

    def rest(self) -> Iterator[tuple[list[int], str]]:
        if self.pages:
            yield self.take()


def in_order(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with a key's rows in one partition and in order; a key of any size streams through its task."""
    return df.repartition(key).sortWithinPartitions(key, *order)


def folded(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Streams ordered rows: make() gives an object with add(row) and end(), both yielding output rows, for each value of the first column."""
    first = df.columns[0]

    def run(batches):
        import pyarrow as pa

        at, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if state is None or row[first] != at:
                    if state is not None:
                        out.extend(state.end())
                    at, state = row[first], make(row[first])
                out.extend(state.add(row))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if state is not None and (out := list(state.end())):
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


class _Grouping:
    def __init__(self, doc, n: int, most: int):
        self.doc, self.number, self.batcher = doc, 0, Batcher(n, most)

    def _rows(self, batches):
        for pages, text in batches:
            yield {"doc_id": self.doc, "group_no": self.number, "pages": pages, "text": text}
            self.number += 1

    def add(self, row):
        return self._rows(self.batcher.add(row["page"], row["block"]))

    def end(self):
        return self._rows(self.batcher.rest())


def char_groups(pages: DataFrame, n: int, most: int) -> DataFrame:
    """(doc_id, group_no, pages, text): up to n pages and most characters of page blocks, in page order, blanks left out.

    A block longer than that is cut and stands alone.
    """
    some = pages.filter(~blank(F.col("text"))).select("doc_id", F.col("page").cast("int").alias("page"), page_block(F.col("page"), F.col("text")).alias("block"))
    kind = dict(pages.dtypes)["doc_id"]
    return folded(in_order(some, "doc_id", "page"), lambda doc: _Grouping(doc, n, most), f"doc_id {kind}, group_no int, pages array<int>, text string")
