"""Page selections: parsing, merging, resolving against documents, and byte ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

MOST_PAGE = 1_000_000


def parse_spec(spec: Column) -> Column:
    """struct<ranges array<struct<start,stop>>, error string> of a text such as '1,3,5-8'; a null spec selects all pages."""
    entries = F.transform(F.split(spec, ",", -1), lambda e: F.trim(e))
    number = lambda s: F.trim(s).try_cast("long")
    start = lambda e: number(F.split_part(e, F.lit("-"), F.lit(1)))
    stop = lambda e: F.when(e.contains("-"), number(F.split_part(e, F.lit("-"), F.lit(2)))).otherwise(start(e))
    wrong = lambda e: (
        F.when(e == "", "empty entry")
        .when(~e.rlike(r"^\d{1,18}(?:\s*-\s*\d{1,18})?$"), "not a page or a range")
        .when(start(e) < 1, "page below 1")
        .when((start(e) > MOST_PAGE) | (stop(e) > MOST_PAGE), "page too large")
        .when(stop(e) < start(e), "range runs backwards")
    )
    error = F.when(F.trim(spec) == "", "empty selection").otherwise(F.try_element_at(F.filter(F.transform(entries, wrong), lambda x: x.isNotNull()), F.lit(1)))
    ranges = F.when(error.isNull() & spec.isNotNull(), F.transform(entries, lambda e: F.struct(start(e).alias("start"), stop(e).alias("stop"))))
    return F.struct(ranges.alias("ranges"), error.alias("error"))


def single_pages(pages: Column) -> Column:
    """An array of numbers as ranges of one page."""
    return F.transform(pages, lambda p: F.struct(p.cast("long").alias("start"), p.cast("long").alias("stop")))


def merge_ranges(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, stop) of df's ranges, overlapping and adjoining ones made one."""
    order = W.partitionBy(key).orderBy("start", "stop")
    reached = F.max("stop").over(order.rowsBetween(W.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") <= reached + 1, 0).otherwise(1)).over(order)
    return df.select(key, "start", "stop").withColumn("island", island).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def format_ranges(ranges: Column) -> Column:
    """'a-b' or 'a', comma-joined, of an array of structs in order."""
    one = lambda r: F.when(r["start"] == r["stop"], r["start"].cast("string")).otherwise(F.concat_ws("-", r["start"], r["stop"]))
    return F.array_join(F.transform(F.array_sort(ranges), one), ",")


def resolve(ranges: DataFrame, documents: DataFrame) -> DataFrame:
    """Merged ranges (doc_id, start, stop) against documents (doc_id, n_pages).

    (doc_id, n_pages, processed, selected, clamped, error): ranges past the end go, ends are cut, and an
    error says that nothing is left. selected counts pages.
    """
    joined = ranges.join(documents.select("doc_id", "n_pages"), "doc_id")
    inside = F.col("start") <= F.col("n_pages")
    cut = F.when(inside, F.struct("start", F.least("stop", "n_pages").alias("stop")))
    out = joined.groupBy("doc_id", "n_pages").agg(F.collect_list(cut).alias("cut"), (F.max("stop") > F.first("n_pages")).alias("clamped"))
    pages = F.aggregate("cut", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"] + 1)
    return out.select("doc_id", "n_pages", format_ranges(F.col("cut")).alias("processed"), pages.alias("selected"), "clamped", F.when(F.size("cut") == 0, "no page of the document is selected").alias("error"))


def select_pages(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Rows of pages (doc_id, page, ...) that a range of their document holds, each once."""
    r = ranges.select(F.col("doc_id").alias("of"), "start", "stop")
    return pages.join(r, (F.col("doc_id") == F.col("of")) & F.col("page").between(F.col("start"), F.col("stop")), "left_semi")


def islands(pages: DataFrame) -> DataFrame:
    """(doc_id, start, stop) of runs of consecutive page numbers."""
    p = pages.select("doc_id", F.col("page").cast("long").alias("page")).distinct()
    run = F.col("page") - F.row_number().over(W.partitionBy("doc_id").orderBy("page"))
    return p.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("page").alias("start"), F.max("page").alias("stop")).drop("run")


def contiguous(pages: DataFrame) -> DataFrame:
    """(doc_id, contiguous): whether the document's pages run without a gap or a repeat."""
    return pages.groupBy("doc_id").agg(((F.max("page") - F.min("page") + 1 == F.count("*")) & (F.count_distinct("page") == F.count("*"))).alias("contiguous"))


def prefer_body(body: Column, query: Column) -> Column:
    """The body's selection unless it is null; an empty one still stands."""
    return F.coalesce(body, query)


def blanks_for_skipped(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Every page 1..n_pages of documents, with '' where pages has none."""
    grid = documents.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page"))
    return grid.join(pages.select("doc_id", F.col("page").cast("int").alias("page"), "text"), ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"))


def byte_slice(length: Column, start: Column, stop: Column) -> Column:
    """struct<start, stop> (both in) of an HTTP byte range, null where it can't be met; a null start asks for a suffix."""
    suffix = F.struct(F.greatest(length - stop, F.lit(0)).alias("start"), (length - 1).alias("stop"))
    plain = F.struct(start.alias("start"), F.least(F.coalesce(stop, length - 1), length - 1).alias("stop"))
    return F.when(length <= 0, None).when(start.isNull(), F.when(stop > 0, suffix)).when((start >= 0) & (start < length) & (stop.isNull() | (stop >= start)), plain)
