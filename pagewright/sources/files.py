"""Document files, file references, and sinks for traces and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import clipped

MOST_BYTES = 300 * 1024 * 1024


def scan_documents(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(path, length, modified, content, error) of files below path; a file in error has no content.

    The length test uses the listing, so that a file that is too large is never read. Spark passes over
    empty files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    size = files.filter(F.col("length") <= most)
    head = size.withColumn("error", F.when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "not a PDF"))
    good = head.select("path", "length", F.col("modificationTime").alias("modified"), F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")
    wrong = files.filter(F.col("length") > most).select("path", "length", F.col("modificationTime").alias("modified"), F.lit(None).cast("binary").alias("content"), F.lit("too large").alias("error"))
    return good.unionByName(wrong)


def safe_name(file_id: Column) -> Column:
    """A file's name for an id, with .pdf where it has no extension; null for an id that could leave the folder."""
    s = F.trim(file_id)
    wrong = (F.length(s) < 1) | (F.length(s) > 180) | s.isin(".", "..") | s.contains("..") | s.rlike(r"[/\\:\x00-\x1f\x7f]")
    return F.when(~wrong, F.when(s.contains("."), s).otherwise(F.concat(s, F.lit(".pdf"))))


def is_web_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(r"^(?i:https?)://[^/\s?#]+"), F.lit(False))


def accepted_refs(refs: DataFrame) -> DataFrame:
    """refs (file_id, url, root): without a root both an id and a web URL are needed; with one the id does, and a bad URL becomes null."""
    has_id, rooted = F.length(F.trim(F.coalesce("file_id", F.lit("")))) > 0, F.length(F.trim(F.coalesce("root", F.lit("")))) > 0
    return refs.filter(has_id & (rooted | is_web_url(F.col("url")))).withColumn("url", F.when(is_web_url(F.col("url")), F.col("url")))


def resolve_refs(refs: DataFrame, listing: DataFrame) -> DataFrame:
    """refs with kind (local, remote, missing) and place; a file of listing (root, name) comes before a URL."""
    r = refs.withColumn("name", safe_name(F.col("file_id")))
    there = listing.select("root", "name", F.lit(True).alias("there")).distinct()
    r = r.join(there, ["root", "name"], "left")
    kind = F.when(F.col("there"), "local").when(is_web_url(F.col("url")), "remote").otherwise("missing")
    place = F.when(F.col("there"), F.concat_ws("/", "root", "name")).when(is_web_url(F.col("url")), F.col("url"))
    return r.select("file_id", "url", "root", kind.alias("kind"), place.alias("place"))


def adopted(shared: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs whose shared file {job_id}.pdf has the length that the job says; partial files never match."""
    s = shared.select(F.regexp_extract("name", r"^(.*)\.pdf$", 1).alias("id"), F.col("length").alias("shared_length"))
    return jobs.join(s, (F.col("job_id") == F.col("id")) & (F.col("length") == F.col("shared_length")), "left_semi")


def byte_ranges(files: DataFrame, least: int = 1 << 20, parts: int = 8) -> DataFrame:
    """(file_id, part, start, stop) to fetch a file (file_id, length) in up to parts pieces of least bytes or more."""
    n = F.greatest(F.lit(1), F.least(F.lit(parts), F.floor(F.col("length") / least))).cast("int")
    cut = files.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda k: F.floor(F.col("length") * k / F.col("n"))
    return cut.select("file_id", "part", at(F.col("part")).alias("start"), (at(F.col("part") + 1) - 1).alias("stop"))


def trace_pages(pages: DataFrame, most: int = 8192) -> DataFrame:
    """One JSON line per page: its text cut to most characters (none for 0), with chars and truncated."""
    text = F.when(F.lit(most) > 0, clipped(F.col("text"), max(most, 1)))
    body = F.struct(F.lit("page").alias("kind"), "doc_id", "page", F.length("text").cast("long").alias("chars"), (F.length("text") > most).alias("truncated"), text.alias("text"))
    return pages.select("doc_id", "page", F.to_json(body).alias("value"))


def write_trace(pages: DataFrame, path: str, most: int = 8192) -> None:
    trace_pages(pages, most).select("value").write.mode("append").text(path)


def write_report(pages: DataFrame, path: str, most: int = 1500) -> None:
    """Per-page results as tab-separated text, texts cut and on one line."""
    line = F.regexp_replace(clipped(F.col("text"), most), r"[\t\r\n]+", " ")
    pages.withColumn("text", line).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def write_callbacks(results: DataFrame, path: str) -> None:
    """One JSON object per document, to be posted by whoever reads the folder."""
    results.write.mode("append").json(path)


VISION_CHARS = 8000  # of a vision model's text that count


def recognise(pages: DataFrame, engine, schema: str = "doc_id long, page int, text string, ocr_ms double", most: int | None = None) -> DataFrame:
    """Runs an outside engine over pages that have no usable text layer.

    engine is a function of an iterator of Arrow batches. The filter is put before it, so that pages with
    a text layer never reach it. Texts are cut to most characters (VISION_CHARS for a vision model).
    """
    todo = pages.filter(~F.col("use_layer"))
    done = todo.mapInArrow(engine, schema)
    text = F.trim(F.regexp_replace("text", "\r", ""))
    return done.withColumn("text", text if most is None else clipped(text, most))
