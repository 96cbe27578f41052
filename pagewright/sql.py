"""The library in SQL: column rules as functions, page batches and selections as table functions, pages as views."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F
from pyspark.sql.functions import udtf

from .functions import text as tx
from .operators import classify, groups, ranges
from .sources import files

#: SQL name: (its arguments, its type, the rule). Only rules without lambdas, which have no SQL text.
RULES = {
    "is_blank_page": ("text STRING", "BOOLEAN", tx.blank),
    "line_breaks": ("text STRING", "STRING", tx.line_breaks),
    "nonspace_count": ("text STRING", "BIGINT", tx.nonspace_count),
    "fold_text": ("text STRING", "STRING", tx.fold),
    "repair_name": ("name STRING", "STRING", tx.repair),
    "repair_person": ("name STRING", "STRING", tx.repair_person),
    "name_identity": ("name STRING", "STRING", tx.identity),
    "acceptable_person": ("name STRING", "BOOLEAN", tx.acceptable_person),
    "acceptable_company": ("name STRING", "BOOLEAN", tx.acceptable_company),
    "is_branch_of": ("longer STRING, shorter STRING", "BOOLEAN", tx.is_branch),
    "page_block": ("page INT, text STRING", "STRING", tx.page_block),
    "layer_mode": ("mode STRING", "STRING", classify.layer_mode),
    "safe_file_name": ("file_id STRING", "STRING", files.safe_name),
}


@udtf(returnType="doc_id BIGINT, group_no INT, pages ARRAY<INT>, text STRING")
class GroupPages:
    """Rows (doc_id, page, text) of one document in page order as groups of up to n pages and most characters.

    SELECT * FROM group_pages(TABLE(pages) PARTITION BY doc_id ORDER BY (page), 10, 300000)
    """

    def __init__(self):
        self.doc, self.number, self.batcher = None, 0, None

    def _rows(self, batches) -> Iterator[tuple]:
        for pages, text in batches:
            yield self.doc, self.number, pages, text
            self.number += 1

    def eval(self, row: Row, n: int, most: int) -> Iterator[tuple]:
        if self.batcher is None:
            self.doc, self.batcher = row["doc_id"], groups.Batcher(n, most)
        text = row["text"]
        if text is not None and text.strip():
            yield from self._rows(self.batcher.add(row["page"], f"--- page {row['page']} ---\n{text}\n"))

    def terminate(self) -> Iterator[tuple]:
        if self.batcher is not None:
            yield from self._rows(self.batcher.rest())


_ENTRY = re.compile(r"([0-9]{1,18})(?:[ \t\n\x0b\f\r]*-[ \t\n\x0b\f\r]*([0-9]{1,18}))?")


@udtf(returnType="start BIGINT, stop BIGINT, error STRING")
class PageRanges:
    """The ranges of a page selection such as '1,3,5-8', in order of writing, or one row with an error; null, all pages, is a row of nulls.

    SELECT * FROM jobs, LATERAL page_ranges(spec)
    """

    def eval(self, spec: str) -> Iterator[tuple]:
        if spec is None:
            yield None, None, None
            return
        if not spec.strip(" "):
            yield None, None, "empty selection"
            return
        found = []
        for entry in spec.split(","):
            entry = entry.strip(" ")
            match = _ENTRY.fullmatch(entry)
            start = int(match[1]) if match else 0
            stop = int(match[2] or start) if match else 0
            error = "empty entry" if not entry else "not a page or a range" if not match else "page below 1" if start < 1 else None
            if error is None and max(start, stop) > ranges.MOST_PAGE:
                error = "page too large"
            if error is None and stop < start:
                error = "range runs backwards"
            if error:
                yield None, None, error
                return
            found.append((start, stop, None))
        yield from found


def _sql_text(spark: SparkSession, args: str, rule) -> str:
    """The rule as SQL text, from the same expression that DataFrames get."""
    df = spark.createDataFrame([], args)
    made: Column = rule(*[F.col(c) for c in df.columns])
    return df.select(made.alias("v"))._jdf.queryExecution().analyzed().expressions().head().child().sql()


def register(spark: SparkSession) -> None:
    """Makes RULES, group_pages and page_ranges known to the session's SQL."""
    for name, (args, kind, rule) in RULES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {_sql_text(spark, args, rule)}")
    spark.udtf.register("group_pages", GroupPages)
    spark.udtf.register("page_ranges", PageRanges)


def page_views(pages: DataFrame) -> None:
    """Views of pages (doc_id, page, text): doc_pages, page_facts (blank, chars, nonspace) and page_heads (head: what follows)."""
    pages.createOrReplaceTempView("doc_pages")
    facts = pages.select("doc_id", "page", tx.blank(F.col("text")).alias("blank"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), tx.nonspace_count(F.col("text")).alias("nonspace"))
    facts.createOrReplaceTempView("page_facts")
    groups.lookahead(pages).select("doc_id", "page", "head").createOrReplaceTempView("page_heads")
