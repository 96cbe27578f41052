"""A corpus pipeline of five stages, each the work of one operator of pagewright.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.llm.mixing import mixed_documents
from pagewright.llm.packing import pack
from pagewright.llm.quality import fit_quality, score_quality
from pagewright.llm.scratch import drop, root, swept
from pagewright.llm.secrets import without_secrets
from pagewright.llm.similar import one_of_each

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network gives a score of 0.5 or more. It learns from labelled rows of docs.

    Null and empty texts are scored like others, a null id has no label, repeated rows stay or go together;
    columns beyond those of documents go; no rows give no rows.
    """
    net = fit_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs.select(*COLUMNS), net).filter("score >= 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: five words, 0.8 of all shingles, and chains of them.

    The row with the smallest doc_id stays, null last; of ties the least digest of text and row. Rows that
    only share an id are no copies; null and empty texts are alike; no rows give no rows.
    """
    return one_of_each(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by their kind in brackets and n_chars as it is then.

    Texts without secrets, null and empty ones too, stay as they are, n_chars included; repeated rows stay
    each; null ids are ids like others; no rows give no rows.
    """
    rows = without_secrets(docs.select(*COLUMNS))
    text, n = F.coalesce("clean", "row.text"), F.coalesce(F.length("clean").cast("long"), "row.n_chars")
    return rows.select("row.doc_id", text.alias("text"), "row.lang", "row.source", n.alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, none to three times.

    Null sources are one source; rows that repeat an id, null ones too, are taken alike; a text without
    words goes with its hash; no rows give no rows.
    """
    return mixed_documents(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in their places in sequences of 2048 tokens.

    A null or empty text is its end token; repeated rows, as the mix makes them, and null ids get pieces
    each; no rows give no rows.
    """
    import public_tokenizers

    return pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents. What a stage leaves in the shared folder goes when its result is written, and that when the next one's is."""
    docs, folder, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), root(spark), None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        with swept(spark):
            made = stage(spark, docs, sf_dir)
            made.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            drop(before, spark=spark)
        before = path
    return docs


#: The quality network, SimHash over XXH64 and token ids are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None
