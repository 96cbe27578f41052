"""Choosing between a page's text layer and recognition, and projections of page results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank, nonspace_count

UNKNOWN_SHARE, IMAGE_SHARE, LEAST_CHARS, LEAST_ON_IMAGE = 0.02, 0.55, 40, 200


def layer_mode(mode: Column) -> Column:
    m = F.lower(F.trim(F.coalesce(mode, F.lit(""))))
    return F.when(m.isin("off", "force"), m).otherwise("auto")


def classify_layer(stats: DataFrame) -> DataFrame:
    """stats (mode, text, char_count, unknown_count, text_objects, invisible, image_coverage, ...) with use_layer and reason.

    The order of the tests counts: the first that holds names the reason.
    """
    seen = nonspace_count(F.col("text"))
    mode = layer_mode(F.col("mode"))
    on_image = (F.col("image_coverage") >= IMAGE_SHARE) | F.col("invisible")
    reason = (
        F.when(mode == "off", "off")
        .when((F.col("text_objects") == 0) | (seen == 0), "no-text")
        .when(mode == "force", "force")
        .when(F.col("unknown_count") / F.greatest(F.col("char_count"), seen) > UNKNOWN_SHARE, "unknown-chars")
        .when(on_image & (seen < max(LEAST_CHARS, LEAST_ON_IMAGE)), "image-little-text")
        .when(~on_image & (seen < LEAST_CHARS), "short-text")
        .when(F.col("invisible"), "invisible-layer")
        .otherwise("text")
    )
    return stats.withColumn("reason", reason).withColumn("use_layer", F.col("reason").isin("force", "text", "invisible-layer"))


def source_counts(pages: DataFrame) -> DataFrame:
    """(doc_id, layer_pages, ocr_pages)."""
    return pages.groupBy("doc_id").agg(F.count_if(F.col("source") == "textLayer").alias("layer_pages"), F.count_if(F.col("source") == "ocr").alias("ocr_pages"))


def visible(pages: DataFrame) -> DataFrame:
    """Pages with text or with at least one rule (rule_count)."""
    return pages.filter(~blank(F.col("text")) | (F.col("rule_count") > 0))


def debug_pages(asked: DataFrame, results: DataFrame) -> DataFrame:
    """Asked pages with what is known of them; ms_per_page is the document's time over its pages, to one place, half to even."""
    per = results.groupBy("doc_id").agg(F.bround(F.sum("ocr_ms") / F.count("*"), 1).alias("ms_per_page"))
    out = asked.join(results.select("doc_id", "page", "text", "ocr_ms"), ["doc_id", "page"], "left").join(per, "doc_id", "left")
    return out.select("doc_id", "page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ocr_ms", F.lit(0.0)).alias("ocr_ms"), F.coalesce("ms_per_page", F.lit(0.0)).alias("ms_per_page"))
