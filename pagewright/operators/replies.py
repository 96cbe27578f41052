"""Model replies: lenient JSON in three shapes, as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import json_object, strict_json

#: Names under which a hit's name and count may stand; the first that is there counts.
NAME_KEYS = ("n", "name", "companyName", "personName", "company", "person")
COUNT_KEYS = ("c", "count")
_NUMBER = r"^(?:BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def _key(v: Column, *names: str) -> Column:
    """The value under the first of names that an object has."""
    return F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in names])


def _items(v: Column) -> Column:
    """An array's values, null for anything else."""
    return F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def loose_text(v: Column, kind: Column) -> Column:
    """A string, trimmed, or a number as text; '' for anything else."""
    return F.when(kind == "STRING", F.trim(_text(v))).when(kind.rlike(_NUMBER), _text(v)).otherwise("")


def whole(v: Column, kind: Column) -> Column:
    """A number, fractions cut off, or a whole number in a string; 0 for anything else."""
    number = F.when(kind.rlike(_NUMBER), F.try_variant_get(v, "$", "double"))
    said = F.when((kind == "STRING") & F.trim(_text(v)).rlike(r"^[+-]?\d{1,18}$"), F.trim(_text(v)).try_cast("double"))
    n = F.coalesce(number, said, F.lit(0.0))
    return F.when((n > 0) & (n < 2**31), F.floor(n)).otherwise(0).cast("long")


def _once(df: DataFrame, **made: Column) -> DataFrame:
    """df with columns that what follows reads, and doesn't compute again in each of its branches."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("made")).select(*df.columns, "made.*")


def hits_of(items: DataFrame) -> DataFrame:
    """items (i, ...) with name and count in place of i: a name, a [name, count] pair or an object. What is none of them or has no name goes; a count below one is one."""
    i, kind = F.col("i"), F.col("kind_i")
    pair = F.when(kind.startswith("ARRAY"), F.try_variant_get(i, "$", "array<variant>"))
    thing = kind.startswith("OBJECT")
    h = _once(items, kind_i=_kind(i))
    h = _once(h, n=F.when(kind == "STRING", i).when(kind.startswith("ARRAY"), F.try_element_at(pair, F.lit(1))).when(thing, _key(i, *NAME_KEYS)),
              c=F.when(kind.startswith("ARRAY"), F.try_element_at(pair, F.lit(2))).when(thing, _key(i, *COUNT_KEYS)))
    h = _once(h, kind_n=_kind(F.col("n")), kind_c=_kind(F.col("c")))
    h = _once(h, name=loose_text(F.col("n"), F.col("kind_n")), count=F.greatest(whole(F.col("c"), F.col("kind_c")), F.lit(1)).cast("long"))
    return h.filter("name != ''").select(*[c for c in items.columns if c != "i"], "name", "count")


def reply_facts(replies: DataFrame) -> DataFrame:
    """(doc_id, shape, page, kind, name, count) of replies (doc_id, raw).

    The compact shape (p) stands before pages with lists (pages), and those before flat lists, whose page is null.
    Pages below one and items of unknown shape are left out; a reply that is no JSON gives no rows.
    """
    j = replies.select("doc_id", F.explode(F.array(F.try_parse_json(strict_json(json_object(F.col("raw")))))).alias("v")).filter("v IS NOT NULL")
    at = lambda *names: _items(_key(F.col("v"), *names))
    j = j.select("doc_id", "v", at("p").alias("compact"), at("pages").alias("paged"), at("companies").alias("c"), at("persons").alias("r"))
    shape = F.when(F.col("compact").isNotNull(), "compact").when(F.col("paged").isNotNull(), "paged").when(F.col("c").isNotNull() | F.col("r").isNotNull(), "flat")
    entries = F.when(F.col("shape") == "flat", F.array("v")).otherwise(F.coalesce("compact", "paged"))
    rows = j.withColumn("shape", shape).filter("shape IS NOT NULL").select("doc_id", "shape", F.explode(entries).alias("e"))
    rows = _once(rows, n=_key(F.col("e"), "n", "page"), kind_e=_kind(F.col("e"))).filter("kind_e LIKE 'OBJECT%'")
    page = F.when(F.col("shape") != "flat", whole(F.col("n"), F.col("kind_n")))
    rows = _once(rows, kind_n=_kind(F.col("n"))).select("doc_id", "shape", page.alias("page"), "e").filter("shape = 'flat' OR page > 0")
    none = F.array().cast("array<variant>")
    lists = [F.struct(F.lit(kind).alias("kind"), F.coalesce(_items(_key(F.col("e"), *keys)), none).alias("items")) for kind, *keys in (("company", "c", "companies"), ("person", "r", "persons"))]
    items = rows.select("doc_id", "shape", "page", F.explode(F.array(*lists)).alias("l")).select("doc_id", "shape", "page", "l.kind", F.explode("l.items").alias("i"))
    return hits_of(items)


def assigned_only(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Facts whose page belongs to their group: groups has (doc_id, page)."""
    return facts.join(groups.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
