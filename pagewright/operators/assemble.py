"""Facts of names as roll-ups, page rules, hashes and scores."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.spans import SNIPPET_MOST
from ..functions.text import clipped, identity, repair
from .groups import folded, in_order

RULES = {"person": "B04", "company": "B06"}


def roll_up(events: DataFrame) -> DataFrame:
    """(doc_id, kind, name, count, pages) of one row per event (doc_id, kind, name, page)."""
    return events.groupBy("doc_id", "kind", "name").agg(F.count("*").alias("count"), F.sort_array(F.collect_set("page")).alias("pages"))


def roll_up_hits(hits: DataFrame) -> DataFrame:
    """(doc_id, kind, name, count, pages) of hits with counts; a count below one counts as one."""
    h = hits.withColumn("name", repair(F.col("name"))).filter("name != ''")
    return h.groupBy("doc_id", "kind", "name").agg(F.sum(F.greatest(F.col("count"), F.lit(1))).cast("long").alias("count"), F.sort_array(F.collect_set("page")).alias("pages"))


def ranked(names: DataFrame) -> DataFrame:
    """names with place: by count, highest first, then by name."""
    return names.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy(F.desc("count"), "name")))


def first_of_identity(names: DataFrame, order: str = "ord") -> DataFrame:
    """The first row of each identity in a document."""
    w = W.partitionBy("doc_id", identity(F.col("name"))).orderBy(order)
    return names.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def first_on_page(hits: DataFrame, order: str = "ord") -> DataFrame:
    """The first row of each (doc_id, page, kind, name)."""
    w = W.partitionBy("doc_id", "page", "kind", "name").orderBy(order)
    return hits.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def known_rules(rules: DataFrame) -> DataFrame:
    """Rows whose rule_code, trimmed and in capitals, is a known one."""
    code = F.upper(F.trim("rule_code"))
    return rules.withColumn("rule_code", code).filter(code.isin(*RULES.values()))


def page_rules(hits: DataFrame) -> DataFrame:
    """(doc_id, page, rule_list): persons, then companies; each name once with its count and snippets."""
    code = F.when(F.col("kind") == "person", RULES["person"]).otherwise(RULES["company"])
    item = F.struct(F.col("name"), F.greatest(F.col("count"), F.lit(1)).cast("long").alias("count"), F.transform("origin_text", lambda s: clipped(s, SNIPPET_MOST)).alias("origin_text"))
    per = hits.withColumn("rule_code", code).groupBy("doc_id", "page", "rule_code").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return per.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("rule_code", "items"))).alias("rule_list"))


def with_items(rule_list: Column) -> Column:
    """Rules that hold at least one item."""
    return F.filter(rule_list, lambda r: F.size(r["items"]) > 0)


def flat_hits(rules: DataFrame) -> DataFrame:
    """page_rules() as rows again: (doc_id, page, kind, name, count)."""
    r = rules.select("doc_id", "page", F.explode("rule_list").alias("r")).select("doc_id", "page", "r.rule_code", F.explode("r.items").alias("i"))
    kind = F.when(F.col("rule_code") == RULES["person"], "person").otherwise("company")
    return r.filter("page > 0").select("doc_id", "page", kind.alias("kind"), "i.name", F.greatest(F.col("i.count"), F.lit(1).cast("long")).alias("count"))


def prebuilt_or_derived(prebuilt: DataFrame, derived: DataFrame) -> DataFrame:
    """A document's prebuilt rules where it has any, else those derived from names."""
    has = prebuilt.filter(F.size("rule_list") > 0).select("doc_id").distinct()
    return prebuilt.filter(F.size("rule_list") > 0).unionByName(derived.join(has, "doc_id", "left_anti"))


def fill_origins(hits: DataFrame, snippets: DataFrame) -> DataFrame:
    """hits with origin_text from snippets (doc_id, page, kind, name, origin_text) where their own is empty."""
    s = snippets.withColumnRenamed("origin_text", "found")
    own = F.when(F.size("origin_text") > 0, F.col("origin_text"))
    return hits.join(s, ["doc_id", "page", "kind", "name"], "left").withColumn("origin_text", F.coalesce(own, "found", F.array().cast("array<string>"))).drop("found")


class _Digest:
    def __init__(self, doc):
        self.doc, self.sha = doc, hashlib.sha256()

    def add(self, row):
        self.sha.update(f"{row['page']}\n{row['text']}\n".encode())
        return ()

    def end(self):
        yield {"doc_id": self.doc, "sha256": self.sha.hexdigest()}


def text_hash(pages: DataFrame) -> DataFrame:
    """(doc_id, sha256) over 'page, line feed, text, line feed' of all pages in order, blank ones included.

    Pages stream through a running digest, so a document may be of any length; pages of one number go by
    their texts.
    """
    p = pages.select("doc_id", F.col("page").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    return folded(in_order(p, "doc_id", "page", "text"), _Digest, f"doc_id {dict(pages.dtypes)['doc_id']}, sha256 string")


def scores(gold: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall, f1) of distinct names; nothing to find or nothing found is a precision or recall of 1."""
    on = ["doc_id", "kind", "name"]
    both = gold.select(*on).distinct().withColumn("g", F.lit(1)).join(found.select(*on).distinct().withColumn("f", F.lit(1)), on, "full")
    n = both.groupBy(*keys).agg(F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col(other)))
    n = n.withColumns({"precision": share("fp"), "recall": share("fn")})
    return n.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def compare_totals(pages: DataFrame) -> DataFrame:
    """(engine, pages, total_ms, mean_ms, chars, errors) of per-page results (engine, ocr_ms, text, error)."""
    return pages.groupBy("engine").agg(
        F.count("*").alias("pages"), F.round(F.sum("ocr_ms"), 3).alias("total_ms"), F.round(F.avg("ocr_ms"), 3).alias("mean_ms"),
        F.sum(F.length("text")).cast("long").alias("chars"), F.count("error").alias("errors"),
    )


def sanitized(rules: DataFrame) -> DataFrame:
    """Model rules (doc_id, page, rule_code, ord, name, count, origin_text) made fit.

    Known codes only; names repaired, the first of each identity in a rule kept; snippets cut; a count below
    one becomes the number of snippets, one at least.
    """
    r = known_rules(rules).withColumn("name", repair(F.col("name"))).filter("name != ''")
    r = r.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "page", "rule_code", identity(F.col("name"))).orderBy("ord"))).filter("n = 1").drop("n")
    count = F.when(F.col("count") > 0, F.col("count")).otherwise(F.greatest(F.size("origin_text"), F.lit(1))).cast("long")
    return r.withColumns({"count": count, "origin_text": F.transform("origin_text", lambda s: clipped(s, SNIPPET_MOST))})


def attach_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages with the rule_list of rules (doc_id, page, ord, rule_list); of several for a page the last."""
    last = rules.groupBy("doc_id", "page").agg(F.max_by("rule_list", "ord").alias("rule_list"))
    return pages.join(last, ["doc_id", "page"], "left")
