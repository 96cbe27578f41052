"""Canonical exact digests of documents. DataFrame functions only.

A text's canonical form is NFKC, case folded, NFKC again, with white space folded to single blanks and
trimmed. Texts are grouped by 128 bits of xxhash of that form; in a group of several rows the forms
themselves are compared byte by byte, and a form that differs from the group's least gets a number of its
own after the digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .scratch import materialize
from .sieve import kept

KEY = ["kd", "r1", "r2"]
Hashes = Callable[[Column], tuple[Column, Column]]


def canonical(text: Column) -> Column:
    """ICU is part of Spark; its normaliser and case folding run inside the plan."""
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.btrim(F.regexp_replace(nfkc(folded), r"[\s\p{Z}\x85\x1c-\x1f]+", " "))


def wide_hash(form: Column) -> tuple[Column, Column]:
    return F.xxhash64(form), F.xxhash64(F.lit("wide"), form)


def keyed(docs: DataFrame) -> DataFrame:
    """(kd, r1, r2, doc_id, text): a key without nulls that equal rows (doc_id, text) share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.coalesce("doc_id", F.lit(0)).cast("long").alias("kd"), F.xxhash64(text).alias("r1"),
        F.xxhash64(F.lit("row"), F.col("doc_id").isNull(), text).alias("r2"), "doc_id", text.alias("text"),
    )


def _hashed(df: DataFrame, text: str, names: tuple[str, str], hashes: Hashes) -> DataFrame:
    with_form = df.withColumn("form", canonical(F.col(text)))
    a, b = hashes(F.col("form"))
    return with_form.withColumn(names[0], a).withColumn(names[1], b)


def successors(rows: DataFrame) -> DataFrame:
    """rows (key, doc_id, ...) with next, the row after by descending doc_id (null last, then by key); the last's is the first.

    Ranges of the order are walked side by side; each range's last row gets the next range's first. Only
    one row of each range meets the others.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("r1").asc(), F.col("r2").asc()]
    rows = materialize(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "digest_order")
    self = F.struct(*KEY, "c1", "c2")
    within = W.partitionBy("part").orderBy(*order)
    walked = rows.withColumn("after", F.lead(self).over(within)).withColumn("at", F.row_number().over(within))
    heads = walked.filter("at = 1").select(F.col("part").alias("of"), self.alias("head"))
    over = W.orderBy("of")  # one row of each range
    heads = heads.select("of", F.coalesce(F.lead("head").over(over), F.first("head").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("head"))
    return walked.join(heads, F.col("part") == F.col("of")).withColumn("next", F.coalesce("after", "head")).drop("after", "at", "of", "head", "part")


def edited(texts: DataFrame, links: DataFrame) -> DataFrame:
    """(key, text, edited) per row of links (key, n, next): the text's last n div 2 characters replaced by the next's first ones.

    texts has (key, text), perhaps more rows than links needs. A text moves once by its key; only the
    part that the row before takes over moves again.
    """
    one = texts.groupBy(*KEY).agg(F.first("text").alias("text"))
    half = F.floor(F.col("n") / 2).cast("int")
    takes = links.select(*[F.col(f"next.{k}").alias(k) for k in KEY], *[F.col(k).alias(f"to_{k}") for k in KEY], half.alias("half"))
    given = one.join(takes, KEY).select(*[F.col(f"to_{k}").alias(k) for k in KEY], F.col("text").substr(F.lit(1), F.col("half")).alias("given"))
    own = one.join(links.select(*KEY, "n"), KEY)
    return own.join(given, KEY).select(*KEY, "text", F.concat(F.col("text").substr(F.lit(1), F.col("n").cast("int") - half), F.col("given")).alias("edited"))


def collisions(members: DataFrame) -> DataFrame:
    """(c1, c2) of groups of members (c1, c2, form) whose forms differ in any byte.

    Least and greatest form are found before rows move, so equal forms move once a task, not once a row.
    """
    ends = members.groupBy("c1", "c2").agg(F.min("form").alias("a"), F.max("form").alias("z"))
    return ends.filter("a != z").select("c1", "c2")


def document_digests(docs: DataFrame, hashes: Hashes = wide_hash) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text is an empty one. Rows equal in doc_id and text are one document in the order and come
    back each with the same values; rows that only share a doc_id are in order of their hashes; a null
    doc_id is last. A lone document is its own next; no rows give no rows. near_* is 1 for equal fingerprints, else 0.
    """
    texts = keyed(docs)
    narrow = _hashed(texts, "text", ("c1", "c2"), hashes).select(*KEY, "doc_id", F.length("text").cast("long").alias("n"), "c1", "c2")
    rows = narrow.groupBy(*KEY, "doc_id", "n", "c1", "c2").agg(F.count("*").alias("copies"))
    links = materialize(successors(rows), "digest_links")
    body = texts.select(*KEY, "text")
    made = _hashed(edited(body, links.select(*KEY, "n", "next")), "edited", ("e1", "e2"), hashes)
    made = materialize(made.select(*KEY, F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "e1", "e2"), "digest_edited")
    out = links.join(made, KEY)

    # groups of several forms: compare the forms themselves
    sides = links.select(*KEY, F.lit(0).alias("side"), "c1", "c2").union(made.select(*KEY, F.lit(1), "e1", "e2"))
    several = sides.groupBy(F.col("c1").alias("g1"), F.col("c2").alias("g2")).agg(F.count("*").alias("n")).filter("n > 1")
    inside = materialize(sides.join(several, (F.col("c1") == F.col("g1")) & (F.col("c2") == F.col("g2"))).select(*KEY, "side", "c1", "c2"), "digest_groups")
    own, other = inside.filter("side = 0").drop("side"), inside.filter("side = 1").drop("side")
    remade = links.join(other.select(*KEY), KEY, "left_semi").select(*KEY, "n", "next")
    wanted = own.select(*KEY).union(remade.select(*KEY)).union(remade.select(*[F.col(f"next.{k}").alias(k) for k in KEY]))
    some = kept(body, wanted, F.xxhash64(*KEY))
    forms = _hashed(some, "text", ("c1", "c2"), hashes).join(own.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi").select(*KEY, F.lit(0).alias("side"), "c1", "c2", "form")
    forms2 = _hashed(edited(some, remade), "edited", ("c1", "c2"), hashes).select(*KEY, F.lit(1).alias("side"), "c1", "c2", "form")
    members = forms.union(forms2)
    clash = materialize(collisions(members), "digest_clashes")
    number = F.lit(None).cast("int")
    if clash.isEmpty():
        out = out.withColumns({"k": number, "ek": number, "nk": number})
    else:
        odd = materialize(members.join(clash, ["c1", "c2"], "left_semi"), "digest_odd")
        ranks = odd.select("c1", "c2", "form").distinct().withColumn("number", F.row_number().over(W.partitionBy("c1", "c2").orderBy("form")) - 1)
        odd = materialize(odd.join(ranks, ["c1", "c2", "form"]).select(*KEY, "side", "number").distinct(), "digest_numbers")
        for name, side, at in (("k", 0, ""), ("ek", 1, ""), ("nk", 0, "next.")):
            numbered = odd.filter(F.col("side") == side).select(*[F.col(k).alias(f"{name}_{k}") for k in KEY], F.col("number").alias(name))
            on = [F.col(at + k) == F.col(f"{name}_{k}") for k in KEY]
            out = out.join(numbered, on[0] & on[1] & on[2], "left").drop(*[f"{name}_{k}" for k in KEY])

    def digest(a: str, b: str, k: str) -> Column:
        wide = F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))
        return F.concat(wide, F.when(F.col(k) > 0, F.concat(F.lit("-"), F.col(k))).otherwise(F.lit("")))

    out = out.select("doc_id", F.col("n").alias("n_chars"), "edited_sha256", digest("c1", "c2", "k").alias("fingerprint"), digest("e1", "e2", "ek").alias("edited_fingerprint"), digest("next.c1", "next.c2", "nk").alias("next_fingerprint"), "copies")
    near = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")
    out = out.withColumns({"near_edited": near("edited_fingerprint"), "near_next": near("next_fingerprint"), "copy": F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))})
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return document_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
